"""Cross-site boilerplate lines, found by how many distinct sites show a line.

One HyperLogLog sketch for each line hash counts the sites; sketches merge in the partial and final aggregation, so a
line that half of all documents show costs one sketch a task. Only lines whose estimate is near the threshold are
counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stash


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    """(id, version, site, pos, line_key) of each line with something on it; version tells rows of one id apart."""
    # The text is hashed and split before the lines part: otherwise each line's row would carry and hash the whole text.
    whole = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("version"), F.col(site_col).cast("string").alias("site"), F.split(F.col(text_col), "\n", -1).alias("lines"))
    return (
        whole.select("id", "version", "site", F.posexplode("lines").alias("pos", "line"))
        .where(F.trim("line") != "")
        .select("id", "version", "site", "pos", F.unhex(F.md5(F.col("line").cast("binary"))).alias("line_key"))
    )


def boilerplate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10, lg_k: int = 12, band: float = 0.2) -> DataFrame:
    """Lines shown by at least min_sites distinct sites: (line_key, sites, exact, first_id, first_pos).

    An estimate within band of min_sites is replaced by an exact distinct count (exact = true). With lg_k = 12 the
    sketch's standard error is 1.6 %, so the band is over 10 standard errors wide. Null sites are no site.
    first_id, first_pos: the smallest id, then place, that shows the line. Lines that may be flagged are written to the
    shared folder, so that sketches are made once and Spark knows the table's size when it joins lines with it.
    """
    lines = _lines(docs, id_col, text_col, site_col)
    spread = lines.groupBy("line_key").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("estimate"),
        F.min(F.struct("id", "pos")).alias("first"),
    )
    candidates = stash(spread.where(F.col("estimate") >= min_sites * (1 - band)))
    near = candidates.where(F.col("estimate") <= min_sites * (1 + band)).select("line_key")
    counted = (
        lines.join(near, "line_key", "left_semi").select("line_key", "site").where("site IS NOT NULL").distinct()
        .groupBy("line_key").agg(F.count(F.lit(1)).alias("counted"))
    )
    return (
        candidates.join(counted, "line_key", "left")
        .select("line_key", F.coalesce("counted", "estimate").alias("sites"), F.col("counted").isNotNull().alias("exact"), F.col("first.id").alias("first_id"), F.col("first.pos").alias("first_pos"))
        .where((F.col("sites") >= min_sites))
    )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = 10, keep_first: bool = True, lg_k: int = 12, band: float = 0.2) -> DataFrame:
    """docs with boilerplate lines taken out of text_col, plus n_lines and n_removed (long).

    A line (split at LF, compared byte by byte) is boilerplate when at least min_sites distinct sites show it. With
    keep_first its first showing (smallest id, then place) stays, so no content is lost from the corpus; otherwise all
    go. Lines of white space only are never boilerplate. A null text stays null with 0 lines; a text whose every line
    goes becomes empty; the row stays. Repeated rows of one id are treated alike; a null id works as an id of its own.
    Extra columns stay; columns called n_lines and n_removed are replaced.
    """
    flagged = boilerplate_lines(docs, id_col, text_col, site_col, min_sites, lg_k, band)
    lines = _lines(docs, id_col, text_col, site_col).select("id", "version", "pos", "line_key")
    hit = lines.join(stash(flagged.select("line_key", "first_id", "first_pos")), "line_key")
    if keep_first:
        hit = hit.where(~(F.col("id").eqNullSafe(F.col("first_id")) & (F.col("pos") == F.col("first_pos"))))
    gone = hit.groupBy(F.col("id").alias("__ef_id"), F.col("version").alias("__ef_version")).agg(F.sort_array(F.collect_set("pos")).alias("__ef_gone"))
    base = docs.drop(*(c for c in ("n_lines", "n_removed") if c in docs.columns))
    joined = base.join(gone, base[id_col].eqNullSafe(F.col("__ef_id")) & (F.xxhash64(base[text_col]) == F.col("__ef_version")), "left")
    text, gone_at = F.col(text_col), F.col("__ef_gone")

    def without(lines: Column) -> Column:
        """The parts between removed lines, joined: lines and removed places are each walked once. lines is a bound variable,
        so the text is split once and not for each part."""
        begins, ends = F.concat(F.array(F.lit(0)), F.transform(gone_at, lambda p: p + 1)), F.concat(gone_at, F.array(F.size(lines)))
        parts = F.zip_with(begins, ends, lambda b, e: F.slice(lines, b + 1, e - b))
        return F.array_join(F.flatten(parts), "\n")

    kept = F.when(gone_at.isNull(), text).otherwise(F.transform(F.array(F.split(text, "\n", -1)), without)[0])
    return joined.select(
        *(kept.alias(c) if c == text_col else F.col(c) for c in base.columns),
        F.coalesce(F.size(F.split(F.col(text_col), "\n", -1)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("__ef_gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
