"""Groups of spelling variants, by merging the subtrees of an errata trie.

Words form a trie, a row for each prefix. At each node the child with most words is heavy and the others are light, so that a
word is in a light subtree at no more nodes than the logarithm of the number of words. Only light subtrees move, small to large: each word of one is taken with the
branching character skipped, and with it replaced, into what the node's other subtrees hold, and a word that
ends at the node counts as light. Two words are one edit apart where such a way ends in the end of a word:

- replaced: light words of a node with equal rests meet each other, and each meets the heavy child with the same rest;
- skipped: a light word without its branching character meets the words of the node;
- added: a light word behind the heavy child's character meets the words of that child.

Every pair of words branches at one node, and of equal neighbouring characters the last counts as the skipped one, so a pair is found once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import written

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORT = 2  # prefixes up to this length are a bounded number, so their heavy children can be broadcast


def slipped(doc_id: Column, run: Column, every: int) -> Column:
    """run, without one code point where every divides the hash of document and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run))
    at = (h % F.length(run)).cast("int")
    cut = F.concat(F.substr(run, F.lit(1), at), F.substr(run, at + 2, F.length(run)))
    return F.when(h % every == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, every: int = 97, least_length: int = 5, least: int = 3) -> DataFrame:
    """(word, n): the words of all texts. Words are counted in each task before the shuffle."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    word = slipped(F.col("doc_id"), F.translate("run", UPPER, LOWER), every)
    some = runs.select(word.alias("word")).filter(F.length("word") >= least_length)
    return some.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def light_words(words: DataFrame) -> DataFrame:
    """(word, n, node, c, rest, heavy): each word at each node where its subtree is light: the branching character and what follows
    it, both empty where the word ends at the node, and the heavy child's character, null at a node without children."""
    at = F.sequence(F.lit(0), F.length("word"))
    ways = words.select("word", "n", F.explode(at).alias("p"))
    ways = ways.select("word", "n", "p", F.substr("word", F.lit(1), F.col("p")).alias("node"), F.substr("word", F.col("p") + 1, F.lit(1)).alias("c"), F.substr("word", F.col("p") + 2, F.length("word")).alias("rest"))
    sizes = ways.filter("c <> ''").groupBy("node", "c").agg(F.count(F.lit(1)).alias("size"))
    # of equally large children the first is heavy
    best = written(sizes.groupBy("node").agg(F.min(F.struct((-F.col("size")).alias("s"), F.col("c").alias("c"))).alias("b")).select("node", F.col("b.c").alias("heavy")))
    near, deep = F.length("node") <= SHORT, F.length("node") > SHORT
    # at most 1 + 90 + 90 * 90 prefixes of up to two characters
    top = ways.filter(near).join(F.broadcast(best.filter(near)), "node", "left")
    rest = ways.filter(deep).join(best.filter(deep), "node", "left")
    return top.unionByName(rest).filter("heavy IS NULL OR c <> heavy").select("word", "n", "node", "c", "rest", "heavy")


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): each pair of words one edit apart, in both directions. words: (word, n), each word once."""
    light = written(light_words(words))
    rest, heavy, c = F.col("rest"), F.col("heavy"), F.col("c")
    ends = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    replaced = light.filter("c <> '' AND heavy IS NOT NULL").select("word", "n", F.concat("node", "heavy", "rest").alias("near"))
    skipped = light.filter((c != "") & (c != F.substr(rest, F.lit(1), F.lit(1)))).select("word", "n", F.concat("node", "rest").alias("near"))
    added = light.filter("heavy IS NOT NULL").select("word", "n", F.concat("node", heavy, c, rest).alias("near"))
    met = replaced.unionByName(skipped).unionByName(added).join(ends, "near").select("word", "n", "near", "near_n")
    # light words of one node with one rest differ in one character, so that there are no more of them than characters
    side = light.filter("c <> ''").groupBy("node", "rest").agg(F.collect_list(F.struct("word", "n")).alias("m")).filter(F.size("m") > 1).select(F.explode("m").alias("x"), "m")
    each = side.select("x", F.explode("m").alias("y")).filter("x.word <> y.word").select(F.col("x.word").alias("word"), F.col("y.word").alias("near"), F.col("y.n").alias("near_n"))
    return met.select("word", "near", "near_n").unionByName(met.select(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))).unionByName(each)


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form), both never null: the end of the chain of forms. Chains halve each round and no chain has a circle."""
    now = written(forms.select("word", F.col("form").alias("root")))
    while True:
        next_ = now.select(F.col("word").alias("at"), F.col("root").alias("on"))
        new = written(now.join(next_, F.col("root") == F.col("at"), "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")))
        moved = new.filter("moved").limit(1).count()
        now = new.select("word", "root")
        if not moved:
            return now


def spelling_variants(docs: DataFrame, every: int = 97, least_length: int = 5, least: int = 3, times: int = 2) -> DataFrame:
    """Words with the word that each is probably a spelling of.

    docs has doc_id and text; other columns are ignored. Words are the maximal runs of Latin letters of every whole text, with A to Z in lower case,
    one of about every of which loses a character by its document's hash (a null id counts as empty). Words with least_length
    characters and least occurrences are kept. Returns word, n, n_near (words one inserted, deleted or replaced character away), form (the
    near word of largest n, of equal ones the first in code-point order, where that n is at least times the word's), form_n and root
    (the end of the chain of forms; the word itself where it has none). Null and empty texts have no words; repeated rows count
    each time, and so do equal texts. An empty table gives no rows.
    """
    words = written(vocabulary(docs, every, least_length, least))
    near = near_words(words).groupBy(F.col("word").alias("of")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("near"))).alias("b"))
    all_ = words.join(near, F.col("word") == F.col("of"), "left")
    has = -F.col("b.m") >= times * F.col("n")
    all_ = written(all_.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("b.near")).alias("form"), F.when(has, -F.col("b.m")).alias("form_n")))
    roots = rooted(all_.filter("form IS NOT NULL").select("word", "form")).withColumnRenamed("word", "of")
    return all_.join(roots, F.col("word") == F.col("of"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    from quarry.llm.common import read

    return spelling_variants(read(spark, sf_dir, "documents").select("doc_id", "text"))
