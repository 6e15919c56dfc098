"""Removal of lines that many sites share.

Every line's hash gets a HyperLogLog sketch of the sites it is found on; sketches are built per task
and merged by aggregation. Estimates clear of the threshold decide at once, the lines near it get an
exact distinct count.
"""

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import free_names

#: Seed of Spark's xxhash64.
SEED = 42


def line_sites(docs: DataFrame, text: str, site: str) -> DataFrame:
    """(doc, line, site) with a digest of the text and a hash of the line; blank lines are left out."""
    return (docs.select(F.md5(text).alias("doc"), F.col(site).alias("site"),
                        F.explode(F.split(text, "\n")).alias("line"))
            .select("doc", "site", F.trim("line").alias("line")).where("line <> ''")
            .select("doc", "site", F.xxhash64("line").alias("line")))


def shared_lines(docs: DataFrame, text: str = "text", site: str = "source", threshold: int = 10,
                 log2_k: int = 12, margin: float = 0.1) -> DataFrame:
    """Hashes of the lines found on at least `threshold` distinct sites; NULL sites count for nothing.

    `margin` is the band around the threshold, as a share of it plus one, in which the exact count
    decides; the standard error of a sketch is 1.04 / sqrt(2 ** log2_k).
    """
    lines = line_sites(docs, text, site).where("site IS NOT NULL").select("line", "site")
    spread = (lines.groupBy("line")
              .agg(F.hll_sketch_agg(F.col("site").cast("string"), F.lit(log2_k)).alias("sketch"))
              .select("line", F.hll_sketch_estimate("sketch").alias("sites")))
    low, high = threshold * (1 - margin) - 1, threshold * (1 + margin) + 1
    sure = spread.where(F.col("sites") > high).select("line")
    near = spread.where(F.col("sites").between(low, high)).select("line")
    exact = (lines.join(near, "line").groupBy("line", "site").agg(F.lit(1).alias("one"))
             .groupBy("line").agg(F.count("*").alias("sites"))
             .where(F.col("sites") >= threshold).select("line"))
    return sure.union(exact)


def remove_shared_lines(docs: DataFrame, text: str = "text", site: str = "source",
                        threshold: int = 10, into: str = "cleaned", only_copies: bool = True,
                        **sketch) -> DataFrame:
    """Add a struct (text, n_lines, n_removed): each text without its cross-site lines.

    Lines are compared without surrounding spaces. Blank lines stay. A text all of whose lines that
    are not blank are shared stays as it is if it is the whole text of several rows, which a search
    for copies handles; a single one loses all those lines. Without `only_copies` a single one stays
    too. A NULL text stays NULL with 0 lines. Rows with equal texts get equal results; all other
    columns stay, but one called `into` is replaced. Rows with a NULL site are cleaned, but do not
    count as a site.
    """
    shared = shared_lines(docs, text, site, threshold, **sketch)
    doc, bad_lines, whole, new = free_names(docs, "_doc", "_shared", "_stays", "_cut")
    hits = (line_sites(docs, text, site).select("doc", "line").distinct().join(shared, "line")
            .groupBy("doc").agg(F.collect_set("line").alias(bad_lines)))
    if only_copies:
        rows = docs.groupBy(F.md5(text).alias("doc")).agg((F.count("*") > 1).alias(whole))
        hits = hits.join(rows, "doc")
    else:
        hits = hits.withColumn(whole, F.lit(True))

    @F.arrow_udf("text string, n_removed long")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, hashes, stays in batches:
            new, removed = [], []
            for value, bad, stay in zip(texts, hashes, stays):
                value = value.as_py()
                if value is None:
                    new.append(None)
                    removed.append(0)
                    continue
                bad = {h % (1 << 64) for h in bad.as_py()}
                lines = value.split("\n")
                filled = [i for i, x in enumerate(lines) if x.strip(" ")]
                gone = {i for i in filled
                        if xxhash.xxh64_intdigest(lines[i].strip(" ").encode(), seed=SEED) in bad}
                if len(gone) == len(filled) and stay.as_py():
                    gone = set()
                new.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
                removed.append(len(gone))
            yield pa.StructArray.from_arrays([pa.array(new, pa.string()), pa.array(removed, pa.int64())],
                                             ["text", "n_removed"])

    # Only texts with a shared line go through Python.
    joined = docs.withColumn(doc, F.md5(text)).join(hits.withColumnRenamed("doc", doc), doc, "left")
    touched = F.col(bad_lines).isNotNull()
    return (joined.withColumn(new, cut(F.when(touched, F.col(text)), F.col(bad_lines), F.col(whole)))
            .withColumn(into, F.struct(
                F.when(touched, F.col(new)["text"]).otherwise(F.col(text)).alias("text"),
                F.coalesce(F.size(F.split(text, "\n")).cast("long"), F.lit(0)).alias("n_lines"),
                F.when(touched, F.col(new)["n_removed"]).otherwise(0).alias("n_removed")))
            .drop(doc, bad_lines, whole, new))
