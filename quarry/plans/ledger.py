"""The ledger operators over the star schema, with SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import ledger as L

QUERIES, ORACLES = {}, {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        ORACLES[f.__name__] = sql
        return f

    return add


@query("""WITH n AS (SELECT o_orderkey AS id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS need FROM orders),
    d AS (SELECT n.id, n.need FROM n JOIN orders o ON o.o_orderkey = n.need WHERE o.o_orderstatus <> 'F')
    SELECT o_orderkey AS id, CASE WHEN need IS NOT NULL THEN 'blocked' WHEN o_orderpriority = '1-URGENT' THEN 'claimed' ELSE 'ready' END AS state, coalesce(CAST(need AS VARCHAR), '') AS blocked_by
    FROM orders LEFT JOIN d ON d.id = o_orderkey WHERE o_orderstatus <> 'F'""")
def ready_set(t):
    o = t("orders")
    items = o.select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("done"), F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("x")).alias("claimed_by"))
    needs = o.select(F.col("o_orderkey").alias("id"), F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("need")).filter("need IS NOT NULL")
    return L.ready_set(items, needs).select("id", "state", "blocked_by")


@query("""SELECT coalesce(n_name, 'TOTAL') AS stage, count(o_orderkey) AS specs, count(*) FILTER (WHERE o_orderstatus = 'F') AS shipped, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS usd
    FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY GROUPING SETS ((n_name), ())""")
def stage_ledger(t):
    sums = t("orders").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("f"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("usd"))
    both = t("nation").join(t("customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(sums, F.col("o_custkey") == F.col("c_custkey"), "left")
    usd = F.coalesce(F.sum("usd"), F.lit(0)).cast("double")
    return both.rollup("n_name").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("specs"), F.coalesce(F.sum("f"), F.lit(0)).alias("shipped"), usd.alias("usd")).select(F.coalesce("n_name", F.lit("TOTAL")).alias("stage"), "specs", "shipped", "usd")


_CARRY = """c AS (SELECT user_id, event_id, event_type, value, last_value(CASE WHEN k % 3 = 0 THEN k END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS iface
    FROM (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events))"""


@query(f"""WITH {_CARRY}, h AS (SELECT user_id, iface, sum(CAST(value AS DECIMAL(18,4))) * 100 AS x, count(*) AS n FROM c GROUP BY ALL), p AS (SELECT iface, n, CAST((floor(x) + CASE WHEN x - floor(x) > 0.5 OR x - floor(x) = 0.5 AND floor(x) % 2 = 1 THEN 1 ELSE 0 END) / 100 AS DECIMAL(18,2)) AS part FROM h)
    SELECT iface, CAST(sum(part) AS DOUBLE) AS usd, CAST(sum(n) AS BIGINT) AS sessions FROM p WHERE iface IS NOT NULL GROUP BY iface""")
def cost_two_phase(t):
    k = F.get_json_object("props", "$.k").cast("int")
    e = L.carried(t("events").withColumn("iface", F.when(k % 3 == 0, k)), "user_id", "event_id", "iface")
    got = L.two_phase(e.filter("iface IS NOT NULL"), "user_id", "iface", F.col("value").cast("decimal(18,4)"))
    return got.select("iface", F.col("usd").cast("double").alias("usd"), "sessions")


@query("""SELECT d.event_type, count(e.event_id) AS n, CAST(coalesce(sum(CAST(value AS DECIMAL(18,2))), 0) AS DOUBLE) AS usd FROM (SELECT DISTINCT event_type FROM events UNION ALL SELECT 'archive') d LEFT JOIN events e USING (event_type) GROUP BY 1""")
def cost_by_cycle(t):
    e = t("events")
    domain = e.select("event_type").distinct().union(e.sparkSession.createDataFrame([("archive",)], "event_type string"))
    got = L.zero_filled(domain, e, "event_type", n=F.count(F.lit(1)), usd=F.sum(F.col("value").cast("decimal(18,2)")))
    return got.select("event_type", "n", F.col("usd").cast("double").alias("usd"))


@query("""SELECT user_id, event_type, CASE WHEN f IS NULL OR f = 0 THEN 'missing' WHEN f < 10 THEN 'implausible' ELSE 'ok' END AS verdict FROM (SELECT user_id, event_type, arg_min(value, event_id) AS f FROM events GROUP BY ALL)""")
def first_session(t):
    return L.first_sessions(t("events"), ["user_id", "event_type"], "event_id", "value", 10.0).select("user_id", "event_type", "verdict")


@query("SELECT p_size, min(p_retailprice) AS low, quantile_disc(p_retailprice, 0.5) AS median, max(p_retailprice) AS high, count(*) AS n FROM part GROUP BY 1")
def size_band(t):
    return L.bands(t("part"), "p_size", "p_retailprice")


@query("""SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN b IS NULL THEN 'unrecorded' WHEN a * 100 > b * 125 THEN 'under' WHEN a * 100 < b * 75 THEN 'over' ELSE 'on' END AS verdict FROM
    (SELECT CAST(l_quantity AS BIGINT) AS a, lag(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS b FROM lineitem)) GROUP BY 1""")
def drift_tally(t):
    a = F.col("l_quantity").cast("long")
    b = F.lag(a).over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    return t("lineitem").select(a.alias("a"), b.alias("b")).groupBy(F.when(F.col("b").isNull(), "unrecorded").otherwise(X.drift(F.col("a"), F.col("b"))).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT s AS status, count(o_orderkey) AS n, count(o_orderkey) * 100 // (SELECT count(*) FROM orders) AS pct FROM (VALUES ('F'), ('O'), ('P'), ('X')) d(s) LEFT JOIN orders ON o_orderstatus = s GROUP BY 1""")
def defect_distribution(t):
    o = t("orders")
    domain = o.sparkSession.createDataFrame([(x,) for x in "FOPX"], "o_orderstatus string")
    got = L.zero_filled(domain, o, "o_orderstatus", n=F.count(F.lit(1)))
    return got.select(F.col("o_orderstatus").alias("status"), "n", X.percent(F.col("n"), F.sum("n").over(Window.partitionBy())).alias("pct"))


@query("SELECT c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_totalprice DESC, c_name DESC LIMIT 3")
def top3_cost(t):
    top = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return top.select("c_name", "o_totalprice").orderBy(F.desc("o_totalprice"), F.desc("c_name")).limit(3)


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '5-LOW' THEN 4 ELSE 5 END, o_orderkey) AS place FROM orders""")
def priority_view(t):
    order = F.when(F.col("o_orderpriority") == "1-URGENT", 1).when(F.col("o_orderpriority") == "2-HIGH", 2).when(F.col("o_orderpriority") == "3-MEDIUM", 3).when(F.col("o_orderpriority") == "5-LOW", 4).otherwise(5)
    return t("orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(order, "o_orderkey")).cast("long").alias("place"))


@query("SELECT CAST(max(CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INT) * 1000 + p_size) + 1 AS BIGINT) AS next_version FROM part")
def next_version(t):
    v = F.struct(F.regexp_extract("p_brand", "([0-9]+)", 1).cast("int").alias("major"), F.col("p_size").alias("minor"))
    top = t("part").agg(F.max(v).alias("v"))
    return top.select((F.col("v.major") * 1000 + F.col("v.minor") + 1).cast("long").alias("next_version"))


@query("""SELECT 'framed' AS half, n_name AS item, coalesce(r_name, '') AS parent FROM nation LEFT JOIN region ON r_regionkey = n_regionkey UNION ALL
    SELECT 'planned', s_name, '' FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) UNION ALL SELECT 'declared', r_name, 'pillar' FROM region""")
def roadmap_union(t):
    framed = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.lit("framed").alias("half"), F.col("n_name").alias("item"), F.coalesce("r_name", F.lit("")).alias("parent"))
    known = t("nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"))
    planned = t("supplier").join(known, "s_nationkey", "left_anti").select(F.lit("planned").alias("half"), F.col("s_name").alias("item"))
    declared = t("region").select(F.lit("declared").alias("half"), F.col("r_name").alias("item"), F.lit("pillar").alias("parent"))
    return framed.unionByName(planned, allowMissingColumns=True).unionByName(declared).fillna("", ["parent"])


_PATH = "regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), '/+$', '')"


@query(f"""WITH p AS (SELECT DISTINCT {_PATH} AS p FROM pages), s AS (SELECT p, CASE WHEN p = '/en' OR p = '/de' OR p = '/fr' OR p = '/es' THEN p ELSE regexp_extract(p, '^(/[^/]*)', 1) END AS top FROM p WHERE p <> '')
    SELECT a.top AS a, count(*) AS nested FROM s a JOIN s b ON b.p = a.top WHERE a.p <> b.p AND starts_with(a.p, b.p || '/') GROUP BY 1 UNION ALL SELECT 'paths', count(*) FROM s""")
def scope_overlap(t):
    """Scopes that nest: a path is under another one of its own ancestors, so it is joined by ancestor, not to all."""
    p = t("pages").select(F.expr(_PATH.replace("'^[a-z]+://[^/]+(/[^?#]*)'", "r'^[a-z]+://[^/]+(/[^?#]*)'")).alias("p")).distinct().filter("p <> ''")
    s = p.withColumn("top", F.regexp_extract("p", "^(/[^/]*)", 1))
    b = s.select(F.col("p").alias("b"))
    both = s.join(b, F.col("top") == F.col("b")).filter(X.scope_relation(F.col("p"), F.col("b")) == "nest")
    return both.groupBy(F.col("top").alias("a")).agg(F.count(F.lit(1)).alias("nested")).unionByName(s.agg(F.count(F.lit(1)).alias("nested")).select(F.lit("paths").alias("a"), "nested"))


@query(f"""SELECT g AS scope, count(*) AS paths FROM (SELECT {_PATH} AS p FROM pages) JOIN (VALUES ('/en/**', '^/en/.*$'), ('/de/*', '^/de/[^/]*$'), ('/fr/?????', '^/fr/.....$'), ('/**.html', '^/.*\\.html$')) v(g, r) ON regexp_matches(p, r) GROUP BY 1""")
def glob_govern(t):
    globs = t("pages").sparkSession.createDataFrame([(g,) for g in ("/en/**", "/de/*", "/fr/?????", "/**.html")], "scope string").withColumn("r", X.glob_regex(F.col("scope")))
    p = t("pages").select(F.expr(_PATH.replace("'^[a-z]+://[^/]+(/[^?#]*)'", "r'^[a-z]+://[^/]+(/[^?#]*)'")).alias("p"))
    return p.join(F.broadcast(globs), F.expr("p RLIKE r")).groupBy("scope").agg(F.count(F.lit(1)).alias("paths"))  # four globs


@query("""SELECT l_suppkey AS instance, (SELECT count(DISTINCT p_size) FROM part) - count(DISTINCT p_size) AS missing FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1""")
def script_gap(t):
    expected = t("part").select("p_size").distinct()
    has = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select("l_suppkey", "p_size").distinct()
    wanted = has.select("l_suppkey").distinct().join(F.broadcast(expected), F.lit(True))  # fifty sizes
    gap = wanted.join(has, ["l_suppkey", "p_size"], "left_anti").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("m"))
    return has.select("l_suppkey").distinct().join(gap, "l_suppkey", "left").select(F.col("l_suppkey").alias("instance"), F.coalesce("m", F.lit(0)).alias("missing"))


@query("""WITH d AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey WHEN o_orderkey % 7 = 1 THEN o_orderkey + 1 WHEN o_orderkey % 7 = 3 THEN -o_orderkey END AS superseded_by, CASE WHEN o_orderkey % 14 = 2 THEN o_orderkey - 1 END AS supersedes FROM orders)
    SELECT problem, count(*) AS n FROM (SELECT CASE WHEN a.superseded_by = a.id THEN 'self' WHEN a.superseded_by IS NOT NULL AND b.id IS NULL THEN 'dangling' WHEN a.superseded_by IS NOT NULL AND b.supersedes IS DISTINCT FROM a.id THEN 'one-sided' ELSE 'ok' END AS problem FROM d a LEFT JOIN d b ON a.superseded_by = b.id) GROUP BY 1""")
def supersede_audit(t):
    k = F.col("o_orderkey")
    d = t("orders").select(k.alias("id"), F.when(k % 14 == 2, k - 1).alias("supersedes"), F.when(k % 7 == 0, k).when(k % 7 == 1, k + 1).when(k % 7 == 3, -k).alias("superseded_by"))
    return L.supersede_audit(d).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT problems, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN o_totalprice < 1000 THEN 'low-price' END, CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'bad-status' END, CASE WHEN c_custkey IS NULL THEN 'no-customer' END, CASE WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN 'old' END) AS problems
    FROM orders LEFT JOIN customer ON c_custkey = o_custkey) GROUP BY 1""")
def validate_rows(t):
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    rules = {"low-price": F.col("o_totalprice") < 1000, "bad-status": ~F.col("o_orderstatus").isin("F", "O"), "no-customer": F.col("c_custkey").isNull(), "old": F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")}
    return o.select(F.array_join(F.array_compact(F.array(*[F.when(c, n) for n, c in rules.items()])), ",").alias("problems")).groupBy("problems").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT strftime(o_orderdate, '%G-W%V') AS week, CAST(date_trunc('week', o_orderdate) AS DATE) AS first_day, CAST(date_trunc('week', o_orderdate) AS DATE) + 6 AS last_day, count(*) AS shipped FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL""")
def weekly_ships(t):
    monday, sunday = X.week_bounds(F.col("o_orderdate"))
    return t("orders").filter("o_orderstatus = 'F'").groupBy(X.week_id(F.col("o_orderdate")).alias("week"), monday.alias("first_day"), sunday.alias("last_day")).agg(F.count(F.lit(1)).alias("shipped"))


@query("SELECT user_id, count(*) AS stale FROM events WHERE event_type IN ('click', 'view') AND floor((epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts))) / 86400) > 7 GROUP BY 1")
def stale_items(t):
    return t("events").filter(F.col("event_type").isin("click", "view") & X.stale(F.lit("2024-02-01").cast("timestamp"), F.col("ts"), 7)).groupBy("user_id").agg(F.count(F.lit(1)).alias("stale"))


@query("""WITH s AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part)
    SELECT p_partkey, slug, count(*) OVER (PARTITION BY slug) > 1 AS duplicate, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) + 100 AS new_id FROM s""")
def slug_unique(t):
    w = Window.partitionBy("slug")
    s = t("part").select("p_partkey", X.slugify(F.col("p_name")).alias("slug"))
    return s.select("p_partkey", "slug", (F.count(F.lit(1)).over(w) > 1).alias("duplicate"), (F.row_number().over(w.orderBy("p_partkey")) + 100).cast("long").alias("new_id"))


_CYCLE = "CASE event_type WHEN 'view' THEN 'verify' WHEN 'purchase' THEN 'ship' WHEN 'click' THEN 'build' WHEN 'signup' THEN 'design' ELSE 'frame' END"


@query(f"""SELECT event_id, CASE WHEN p = 'verify' THEN CASE WHEN event_id % 20 = 0 THEN 'rejected' WHEN c = 'ship' THEN 'approved' WHEN c <> 'verify' THEN 'punch-list' ELSE '' END ELSE '' END AS verdict
    FROM (SELECT event_id, c, lag(c) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM (SELECT event_id, user_id, {_CYCLE} AS c FROM events))""")
def verdict_infer(t):
    e = t("events").select("event_id", "user_id", F.expr(_CYCLE).alias("cycle"), F.when(F.col("event_id") % 20 == 0, "rejected").alias("told"))
    return L.transitions(e, "user_id", "event_id", "cycle", "told").select("event_id", F.coalesce("verdict", F.lit("")).alias("verdict"))


@query("""SELECT l_partkey AS part, min(holder) AS holder, count(*) FILTER (WHERE l_suppkey <> holder) AS refused FROM (SELECT *, first_value(l_suppkey) OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 100 + l_linenumber, l_suppkey) AS holder FROM lineitem) GROUP BY 1""")
def lease_claims(t):
    return L.claims(t("lineitem").withColumn("at", F.col("l_orderkey") * 100 + F.col("l_linenumber")), "l_partkey", "at", "l_suppkey").withColumnRenamed("l_partkey", "part")


@query("""SELECT key AS part, who AS holder, n AS claims FROM (SELECT l_partkey AS key, l_suppkey AS who, count(*) OVER (PARTITION BY l_partkey) AS n, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 100 + l_linenumber DESC, l_suppkey DESC) AS r FROM lineitem) WHERE r = 1""")
def lease_steals(t):
    """Every claim is forced, so the last one holds and none is refused."""
    e = t("lineitem").select("l_partkey", "l_suppkey", (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("at"), F.lit(True).alias("force"))
    n = e.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("claims"))
    return L.claims(e, "l_partkey", "at", "l_suppkey", "force").join(n, "l_partkey").select(F.col("l_partkey").alias("part"), "holder", (F.col("claims") - F.col("refused")).alias("claims"))


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS markers, CAST(sum(event_id) AS BIGINT) AS total FROM events")
def idempotent_sync(t):
    """The whole table, two thirds as the ledger and two thirds as what comes in, so that one third is there already."""
    e = t("events").select("event_id", "user_id")
    ledger, incoming = e.filter("event_id % 3 <> 0"), e.filter("event_id % 3 <> 1")
    once = L.sync_once(ledger, incoming, "event_id")
    return L.sync_once(once, incoming, "event_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("markers"), F.sum("event_id").alias("total"))


@query("""SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 6 = 0 THEN 'new' ELSE '' END ELSE c_mktsegment END AS segment FROM customer WHERE c_custkey % 5 <> 0 OR c_custkey % 3 = 0""")
def scalar_upsert(t):
    """Four fifths of the rows are there; changes set, clear and insert."""
    c = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("segment"))
    changes = c.filter("k % 3 = 0").select("k", F.when(F.col("k") % 6 == 0, "new").alias("segment"))
    return L.upsert(c.filter("k % 5 <> 0"), changes, "k", "segment").select("k", F.coalesce("segment", F.lit("")).alias("segment"))


@query("""SELECT c_custkey, field, coalesce(a, '') AS a, coalesce(b, '') AS b FROM (SELECT c_custkey, 'c_name' AS field, c_name AS a, CASE WHEN c_custkey % 10 = 0 THEN upper(c_name) || '!' ELSE c_name END AS b FROM customer UNION ALL
    SELECT c_custkey, 'c_mktsegment', c_mktsegment, CASE WHEN c_custkey % 15 <> 0 THEN c_mktsegment END FROM customer) WHERE a IS DISTINCT FROM b""")
def metadata_diff(t):
    c = t("customer")
    new = c.withColumns({"c_name": F.when(F.col("c_custkey") % 10 == 0, F.concat(F.upper("c_name"), F.lit("!"))).otherwise(F.col("c_name")), "c_mktsegment": F.when(F.col("c_custkey") % 15 != 0, F.col("c_mktsegment"))})
    return L.metadata_diff(c, new, "c_custkey", ["c_name", "c_mktsegment"]).fillna("", ["a", "b"])


@query("""SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN doc_id % 5 = 1 THEN 'size mismatch' WHEN doc_id % 5 = 2 THEN 'sha256 mismatch' ELSE 'present' END AS verdict FROM documents) GROUP BY 1""")
def content_verify(t):
    d = t("documents")
    k = F.col("doc_id")
    manifest = d.select("doc_id", (F.octet_length("text") + F.when(k % 5 == 1, 5).otherwise(0)).alias("bytes"), F.when(k % 5 == 2, F.sha2(F.concat(F.col("text"), F.lit("x")), 256)).otherwise(F.sha2("text", 256)).alias("sha256"))
    files = d.filter(k % 5 != 0).select("doc_id", F.octet_length("text").alias("length"), F.sha2("text", 256).alias("digest"))
    verdict = F.when(F.col("length").isNull(), "missing").when(F.col("length") != F.col("bytes"), "size mismatch").when(F.col("digest") != F.col("sha256"), "sha256 mismatch").otherwise("present")
    return manifest.join(files, "doc_id", "left").groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
