"""Language identification by Bayesian evidence fusion.

A page's text gives likelihoods of its words under each language, learned from labelled documents. The
declared language of the markup and a language or country in the address are noisy readings of the language; how far
they can be trusted is estimated by grouped aggregation, as how often pages of each text language carry each reading. Hosts have priors:
counts of the text's own verdicts on their other pages, smoothed towards the site's, and the
site's towards all pages', by grouped aggregation. The posterior is the normalised product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written

SAMPLE = 2000  # labelled documents of a language that the word model is fitted on, at most
SEEN = 3  # times that the sample has a word before it is known
STRENGTH = 5.0  # pages that the wider prior counts for in a narrower one
BROADCAST = 200_000  # rows
WORD = "[^\\x20\\x09-\\x0D\\p{Punct}0-9]+"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def word_model(docs: DataFrame, sample: int = SAMPLE, seen: int = SEEN) -> tuple[DataFrame, list[str]]:
    """((word, l0, l1 ..), languages): log probabilities of the words of a sample of labelled documents, chosen by hash of id and text, so that ids that are null are no group of their own."""
    share = docs.filter(F.col("lang").isNotNull()).groupBy("lang").agg((F.lit(sample) / F.count(F.lit(1))).alias("share"))  # a row for each language
    some = docs.filter(F.col("lang").isNotNull()).join(F.broadcast(share), "lang").filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < F.col("share") * 1_000_000)
    counts = written(some.select("lang", F.explode(words_of(F.coalesce("text", F.lit("")))).alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    total = {r[0]: r[1] + 1.0 for r in counts.groupBy("lang").agg(F.sum("n")).collect()}  # a row for each language
    langs = sorted(r[0] for r in share.select("lang").collect())
    n = [F.coalesce(F.sum(F.when(F.col("lang") == g, F.col("n"))), F.lit(0)) for g in langs]
    known = counts.groupBy("word").agg(F.sum("n").alias("all"), *[F.log((x + 0.5) / total.get(g, 1.0)).alias(f"l{i}") for i, (g, x) in enumerate(zip(langs, n, strict=True))]).filter(F.col("all") >= seen)
    return written(known.drop("all")), langs


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def site_of(host: Column) -> Column:
    """The last two labels of a host, or three where the last two are a country's general suffix."""
    return F.coalesce(F.nullif(F.regexp_extract(host, "([^.]+\\.(?:com?|org|net|gov|edu|ac)\\.[a-z]{2})$", 1), F.lit("")), F.regexp_extract(host, "([^.]+\\.[^.]+)$", 1))


def few(df: DataFrame) -> DataFrame:
    """df to be broadcast, where a count shows that it is small."""
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def identify(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """A row for each page: page_id, text_lang, declared, address, lang and posterior.

    pages has page_id, url and html, docs doc_id, text and lang; other columns are ignored. A null or empty
    page has no words and rests on its address and host; without any evidence lang is the commonest. Languages are those of docs; without
    labelled documents lang is null. Repeated or null page ids are kept: rows are told apart by a hash of their
    contents, and equal rows get equal results.
    """
    known, langs = word_model(docs)
    markup = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(F.regexp_replace(markup, "(?is)<(script|style)[^>]*>.*?</\\1>|<!--.*?-->", " "), "(?s)<[^>]*>|&[a-z]+;", " ")
    path = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "://[^/]+/([A-Za-z]{2})(?:/|$)", 1))
    host = host_of(F.col("url"))
    site = site_of(host)
    suffix = F.regexp_extract(host, "\\.([a-z]{2})$", 1)
    base = pages.select("page_id", F.struct(F.xxhash64("page_id", "url", "html").alias("a"), F.xxhash64(F.lit(17), "html", "url", "page_id").alias("b")).alias("k"), host.alias("host"), site.alias("site"),
        F.lower(F.regexp_extract(markup, "(?is)<html[^>]*\\slang\\s*=\\s*[\"']?([A-Za-z]+)", 1)).alias("declared"),
        F.when(path.isin(langs), path).when(suffix.isin(langs), suffix).otherwise("").alias("address"), words_of(text).alias("words"))
    hits = base.select("k", F.posexplode("words").alias("at", "word"))
    copies = F.sum((F.col("at") == 0).cast("int"))  # equal pages have one k
    like = hits.join(few(known), "word", "left").groupBy("k").agg((F.count("l0") / copies).alias("n"), *[(F.sum(f"l{i}") / copies).alias(f"s{i}") for i in range(len(langs))]) if langs else hits
    seen = base.drop("words").join(like, "k", "left") if langs else base.drop("words")
    if not langs:
        return seen.select("page_id", *[F.lit(None).cast("string").alias(c) for c in ("text_lang",)], "declared", "address", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("posterior"))
    temper = 1 / F.sqrt(F.greatest(F.coalesce("n", F.lit(1.0)), F.lit(1.0)))  # words depend on each other: n of them say as much as sqrt(n)
    scores = [F.coalesce(F.col(f"s{i}"), F.lit(0.0)) * temper for i in range(len(langs))]
    best = F.array_max(F.array(*[F.struct(s.alias("s"), F.lit(g).alias("g")) for s, g in zip(scores, langs, strict=True)]))
    seen = written(seen.select("page_id", "host", "site", "declared", "address", *[s.alias(f"e{i}") for i, s in enumerate(scores)], F.when(F.col("n") > 0, best["g"]).alias("text_lang")))
    every = range(len(langs))
    own = [F.coalesce((F.col("text_lang") == g).cast("int"), F.lit(0)) for g in langs]
    by_host = seen.groupBy("host", "site").agg(*[F.sum(o).alias(f"h{i}") for i, o in enumerate(own)])
    by_site = by_host.groupBy("site").agg(*[F.sum(f"h{i}").alias(f"t{i}") for i in every])
    whole = by_site.agg(*[F.sum(f"t{i}") for i in every]).first()  # one row
    whole = [x or 0 for x in whole]
    # readings that are no language are one value, so that these are at most languages times (languages + 1) squared rows
    reading = [F.when(F.col(n).isin(langs), F.col(n)).alias(n) for n in ("declared", "address")]
    said = [list(r) for r in seen.filter("text_lang IS NOT NULL").groupBy("text_lang", *reading).count().collect()]

    def readings(at: int) -> DataFrame:
        """(r, p): of each reading the log probabilities that pages of each language carry it, one of each pair added."""
        n = {(g, r): 1.0 for g in langs for r in langs}
        for row in said:
            if row[at] in langs:
                n[row[0], row[at]] += row[3]
        total = {g: sum(n[g, r] for r in langs) for g in langs}
        name = ("declared", "address")[at - 1]
        rows = seen.sparkSession.createDataFrame([(r, [n[g, r] / total[g] for g in langs]) for r in langs], f"{name} string, p_{name} array<double>")
        return F.broadcast(rows.withColumn(f"p_{name}", F.transform(f"p_{name}", lambda x: F.log(x))))  # a row for each language

    both = seen.join(few(by_host.join(by_site, "site")), ["host", "site"]).join(readings(1), "declared", "left").join(readings(2), "address", "left")
    add = lambda xs: sum(xs[1:], xs[0])
    all_ = [F.lit(whole[i]) - own[i] + 1 for i in every]  # all but the page itself
    sites, hosts = ([F.col(f"{c}{i}") - own[i] for i in every] for c in "th")
    site_p = [(sites[i] + STRENGTH * all_[i] / add(all_)) / (add(sites) + STRENGTH) for i in every]
    prior = [F.log((hosts[i] + STRENGTH * site_p[i]) / (add(hosts) + STRENGTH)) for i in every]
    logs = [F.col(f"e{i}") + prior[i] + F.coalesce(F.col("p_declared")[i], F.lit(0.0)) + F.coalesce(F.col("p_address")[i], F.lit(0.0)) for i in every]
    both = both.select("page_id", "text_lang", "declared", "address", F.array(*[F.struct(x.alias("s"), F.lit(g).alias("g")) for x, g in zip(logs, langs, strict=True)]).alias("logs"))
    top = F.array_max("logs")
    odds = F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x["s"] - top["s"]))
    return both.select("page_id", "text_lang", "declared", "address", top["g"].alias("lang"), F.round(1 / odds, 6).alias("posterior"))


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    from quarry.llm.common import read

    return identify(read(spark, sf_dir, "pages"), read(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
