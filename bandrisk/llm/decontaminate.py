"""Short test items found inside documents of any length, by MinHash containment.

Items are partitioned by size, the number of their different shingles, into classes of powers of two.
Of a set of n shingles at least ``threshold * n`` have to occur in a document, so at most ``n - needed``
are missing, and of any ``n - needed + 1`` one is there. So many make an item's signature: those that the
fewest documents have, and of equal ones the smallest hashes. A document that holds an item therefore
holds at least one value of its signature, which makes the search complete whatever the document's
length, and a phrase that many items and documents share brings no pair of them together unless an item
is made of such phrases. A document takes part in a class only with as many of its shingles as the
class's smallest items need. Documents keep all their shingle hashes that any item has, because a
signature of a long document has no room for a short item. Candidates are then verified by the exact
containment of shingles.

Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandrisk.llm.text import lower_ascii, text_key, words
from bandrisk.sources.store import Scratch

SHINGLE = 5
THRESHOLD = 0.8


def _word_hashes(text: Column) -> Column:
    return F.transform(words(lower_ascii(text)), lambda word: F.xxhash64(word))


def _shingle_hashes(hashes: str) -> str:
    """Hashes of every five consecutive words; of all words if there are fewer."""
    at = ", ".join(f"{hashes}[i + {n}]" for n in range(SHINGLE))
    return f"""case when size({hashes}) >= {SHINGLE}
        then transform(sequence(0, size({hashes}) - {SHINGLE}), i -> xxhash64({at}))
        when size({hashes}) > 0 then array(xxhash64({hashes})) else array() end"""


def _shingles(tokens: str) -> str:
    """The different shingles themselves."""
    return f"""array_distinct(case when size({tokens}) >= {SHINGLE}
        then transform(sequence(1, size({tokens}) - {SHINGLE - 1}), i -> array_join(slice({tokens}, i, {SHINGLE}), ' '))
        when size({tokens}) > 0 then array(array_join({tokens}, ' ')) else array() end)"""


def item_shingles(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``(item_id, item_key, size, needed, part, minimum)``: a row for each different shingle hash of an item."""
    sets = (
        items.select("item_id", text_key(F.col("text")).alias("item_key"), _word_hashes(F.col("text")).alias("hashes"))
        .selectExpr("item_id", "item_key", f"array_distinct({_shingle_hashes('hashes')}) as shingles")
        .where("size(shingles) > 0")
        .selectExpr("*", "size(shingles) as size", f"cast(ceil(size(shingles) * {threshold}D - 1e-9D) as int) as needed")
    )
    return sets.selectExpr(
        "item_id", "item_key", "size", "needed", "cast(floor(log2(size)) as int) as part", "explode(shingles) as minimum"
    ).distinct()


def signatures(shingles: DataFrame, counts: DataFrame) -> DataFrame:
    """The rows of ``item_shingles`` that are an item's signature, by ``counts(part, minimum, n)`` of documents."""
    rarest = Window.partitionBy("item_id", "item_key").orderBy(F.coalesce("n", F.lit(0)), "minimum")
    ranked = shingles.join(counts, ["part", "minimum"], "left").withColumn("_rank", F.row_number().over(rarest))
    return ranked.where("_rank <= size - needed + 1 and n > 0").drop("_rank", "n")


def candidates(docs: DataFrame, items: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, doc_key, item_id, item_key)`` of documents that hold a value of an item's signature."""
    shingles = scratch.keep(item_shingles(items, threshold))
    known = shingles.select("part", "minimum").distinct()
    least = shingles.groupBy("part").agg(F.min("needed").alias("least"))
    # Explode once, with only what tells a document from another. No hint: the planner broadcasts
    # the items' shingles if they are small.
    hits = scratch.keep(
        docs.select("doc_id", text_key(F.col("text")).alias("doc_key"), _word_hashes(F.col("text")).alias("hashes"))
        .selectExpr("doc_id", "doc_key", f"explode({_shingle_hashes('hashes')}) as minimum")
        .join(known, "minimum")
        .distinct()
    )
    counts = hits.groupBy("part", "minimum").agg(F.count(F.lit(1)).alias("n"))
    chosen = scratch.keep(signatures(shingles, counts))
    enough = (
        hits.groupBy("doc_id", "doc_key", "part").agg(F.count(F.lit(1)).alias("_n")).join(least, "part").where("_n >= least")
    )
    enough = enough.select(F.col("doc_id").alias("_id"), F.col("doc_key").alias("_key"), F.col("part").alias("_part"))
    same = hits["doc_id"].eqNullSafe(enough["_id"]) & (hits["doc_key"] == enough["_key"]) & (hits["part"] == enough["_part"])
    return (
        hits.join(chosen, ["part", "minimum"])
        .join(enough, same, "left_semi")
        .select("doc_id", "doc_key", "item_id", "item_key")
        .distinct()
    )


def contaminated(docs: DataFrame, items: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, doc_key, item_id, shared, item_shingles, containment)`` for every item in a document.

    A document of ``docs(doc_id, text)`` holds an item of ``items(item_id, text)`` if at least
    ``threshold`` of the item's different five-word shingles occur in it, A-Z lower-cased. A text
    with fewer words is one shingle; NULL texts and texts without words match nothing. Pairs come
    once, however often rows are repeated; ``doc_key`` hashes the text, so that ids that are NULL or
    used twice do not mix texts up. Other columns are left out; an empty table gives no rows.
    """
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("doc_key"), "text")
    found = scratch.keep(candidates(docs, items, scratch, threshold))
    tokens = words(lower_ascii(F.col("text")))
    asked = found.select(F.col("doc_id").alias("_id"), F.col("doc_key").alias("_key")).distinct()
    same = keyed["doc_id"].eqNullSafe(asked["_id"]) & (keyed["doc_key"] == asked["_key"])
    texts = (
        keyed.join(asked, same, "left_semi")
        .dropDuplicates(["doc_id", "doc_key"])
        .select(F.col("doc_id").alias("_id"), F.col("doc_key").alias("_key"), tokens.alias("tokens"))
        .selectExpr("_id", "_key", f"{_shingles('tokens')} as doc_shingles")
    )
    sets = (
        items.select(
            F.col("item_id").alias("_item_id"), text_key(F.col("text")).alias("_item_key"), tokens.alias("tokens")
        )
        .selectExpr("_item_id", "_item_key", f"{_shingles('tokens')} as shingles")
        .distinct()
    )
    by_item = found["item_id"].eqNullSafe(sets["_item_id"]) & (found["item_key"] == sets["_item_key"])
    by_doc = found["doc_id"].eqNullSafe(texts["_id"]) & (found["doc_key"] == texts["_key"])
    return (
        found.join(sets, by_item)
        .join(texts, by_doc)
        .selectExpr(
            "doc_id",
            "doc_key",
            "item_id",
            "size(array_intersect(shingles, doc_shingles)) as shared",
            "size(shingles) as item_shingles",
        )
        .where(f"shared >= cast(ceil(item_shingles * {threshold}D - 1e-9D) as int)")
        .withColumn("containment", F.col("shared") / F.col("item_shingles"))
        .distinct()
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that hold none of the items; NULL texts stay, and so do all columns."""
    found = contaminated(docs, items, scratch, threshold).select(
        F.col("doc_id").alias("_id"), F.col("doc_key").alias("_key")
    )
    keyed = docs.withColumn("_text_key", text_key(F.col("text")))
    same = keyed["doc_id"].eqNullSafe(found["_id"]) & (keyed["_text_key"] == found["_key"])
    return keyed.join(found, same, "left_anti").drop("_text_key")
