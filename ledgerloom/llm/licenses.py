"""License scan: sparse TF-IDF cosine of headers, notices and license files to templates, then inheritance from the nearest ancestor.

Units of a text are compared with templates (whole license texts, their notices, titles and one-line statements): each line that has a
marker alone and with the line before or after it (statements that are wrapped), each paragraph and each block of comment lines that
has one, and of a license file the whole text. Comment signs are no terms, and lines of nothing else end a paragraph. A vector has
one weight per term, count x idf; idf is ln((1 + documents) / (1 + documents with the term)) + 1 over all documents, counted for
all terms of the templates and of the units, so ordinary words lower the cosine a little and rare foreign ones much. A unit's license
is the template with the highest cosine of at least THRESHOLD (ties: the first id by code point), a text's license that of its
best unit; an SPDX-License-Identifier (the first) says it outright, as spelled, with cosine 1. Files named like license
files pass their license to their directory; a file without a license of its own takes that of the nearest ancestor directory
that has one, found by joining its ancestor paths with the directories.

DataFrame functions only. The templates are fixed and few, so their table is broadcast. Units that can't reach the threshold even at the
least length they can have are left out before the rest of their terms is counted; document counts are added up in each task for the
wanted terms alone, and stored once. What joins many rows by a common notice, text or directory is repeated SALT times
on the small side (a row for each license found), so that no key is one task's.

Defined cases: null and empty texts have no license of their own but inherit; several license files in one directory:
the highest cosine, then the first id by code point; a null path is the root's child with no name; rows with equal ids and paths
are told apart by their texts, and repeated rows give repeated rows; extra columns are ignored; an empty table gives an empty
result; chains of any length are single terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import marked, work_dir, written
from .license_texts import FULL, TEMPLATES as TEXTS

THRESHOLD = 0.75
#: Copies of the small side of joins whose keys may be hot.
SALT = 16

#: The paragraphs that grant the permission stand for their license in files that hold no more of it.
TEMPLATES = (*TEXTS, *((name, part) for name, text in FULL for part in text.split("\n\n") if "Permission" in part))
# Every template has one of these and ordinary prose rarely has; signs that start a comment line; what stands between paragraphs.
MARKERS = "licen[sc]|permission|redistribut|unencumbered|creative commons"
_SIGN = "#|//|/?[*]|;|--|%"
BLANK = "\\n[ \\t\\r\\n#*/;%-]*\\n"
COMMENT = f"(?:^[ \\t]*(?:{_SIGN})[^\\n]*\\n?)+"
SPDX = "SPDX-License-Identifier:[ \\t]*([A-Za-z0-9.+-]+(?: (?:AND|OR|WITH) [A-Za-z0-9.+-]+)*)"
_TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"


def looping(pattern: str) -> str:
    """The pattern with its repeated groups possessive, which changes no match here: the JVM's engine then loops and does not recurse, however long a text."""
    return pattern.replace(")*", ")*+").replace(")+", ")++")


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(looping(_TERM)), F.lit(0))


def _vectors(lines: DataFrame, key: list[str], idf: DataFrame) -> DataFrame:
    """key, term, w: the units' weighted terms, all of which `idf` has."""
    counts = lines.select(*key, F.explode("terms").alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))
    return counts.join(idf, "term").withColumn("w", F.col("tf") * F.col("idf"))


def units(text: Column, license_file: Column) -> Column:
    """The pieces of a text that are compared with templates."""
    has = lambda x: x.rlike(f"(?i){MARKERS}")
    lines = F.split(text, "\n", -1)
    windows = F.flatten(F.transform(lines, lambda x, i: F.when(has(x), F.array(x, F.concat_ws(" ", x, F.get(lines, i + 1)), F.concat_ws(" ", F.get(lines, i - 1), x))).otherwise(F.array().cast("array<string>"))))
    paragraphs = F.filter(F.split(text, BLANK, -1), has)
    comments = F.filter(F.regexp_extract_all(text, F.lit("(?md)" + looping(COMMENT)), F.lit(0)), has)
    return F.array_distinct(F.concat(windows, paragraphs, comments, F.when(license_file, F.array(text)).otherwise(F.array().cast("array<string>"))))


def _salted(small: DataFrame) -> DataFrame:
    return small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: Column | None = None, license_file: Column | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, path, own_license, cosine (4 digits), license, inherited_from (a directory)."""
    spark = docs.sparkSession
    base = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.lit(None).cast("string") if path is None else path, F.lit("")).alias("path"), F.coalesce(F.lit(None).cast("boolean") if license_file is None else license_file, F.lit(False)).alias("is_file"))
    base = base.withColumn("is_marked", F.col("text").rlike(f"(?i){MARKERS}"))
    templates = spark.createDataFrame([(i, name, text_) for i, (name, text_) in enumerate(TEMPLATES)], "t int, license string, text string").select("t", "license", _terms(F.col("text")).alias("terms"))
    vocabulary = sorted({term for _, text_ in TEMPLATES for term in _term_list(text_)})
    # A text and a unit are known by their digests; equal ones are compared once.
    digest, folder = F.sha2("text", 256), work_dir(spark, "licenses")
    held_units = base.where("is_marked").select(digest.alias("digest"), F.explode(units(F.col("text"), F.col("is_file"))).alias("unit"))
    held_units = held_units.select("digest", "unit", F.sha2("unit", 256).alias("key"))
    distinct = written(held_units.groupBy("key").agg(_terms(F.first("unit")).alias("terms")), f"{folder}/units")
    rows = base.count()

    def idf_of(wanted: DataFrame, name: str) -> DataFrame:
        """The idf of the wanted terms, by document counts over all texts; other terms are not shuffled."""
        all_ = base.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
        held = marked(all_, wanted, "term").groupBy("term").agg(F.count("*").alias("df"))
        df = written(wanted.join(held, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df")), f"{folder}/{name}")
        return df.select("term", (F.log((1 + F.lit(rows)) / (1 + F.col("df"))) + 1).alias("idf"))

    words = spark.createDataFrame([(x,) for x in vocabulary], "term string")
    idf = idf_of(words, "df-templates")
    template_w = _vectors(templates, ["t", "license"], idf)
    norms = template_w.groupBy("t").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("tn"))
    template_w = written(template_w.join(norms, "t").select("t", "license", "term", (F.col("w") / F.col("tn")).alias("tw")), f"{folder}/templates")
    # A unit's product with a template needs the templates' terms only. Its length is at least that of these terms and of one for each other
    # word (no idf is below 1), so what stays below the threshold with that length can't reach it: only the rest is weighed in full.
    # Units go to tasks by key once, so a unit's terms, products and length meet without another shuffle.
    tokens = distinct.select("key", F.size("terms").alias("n"), F.filter("terms", lambda x: x.isin(*vocabulary)).alias("terms")).repartition("key").select("key", "n", F.explode("terms").alias("term")).join(F.broadcast(idf), "term")
    tokens = tokens.groupBy("key", "term").agg(F.first("n").alias("n"), F.count("*").alias("tf"), F.first("idf").alias("idf")).withColumn("w", F.col("tf") * F.col("idf"))
    least = tokens.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w")) + F.first("n") - F.sum("tf")).alias("least"))
    products = tokens.join(F.broadcast(template_w), "term").groupBy("key", "t", "license").agg(F.sum(F.col("w") * F.col("tw")).alias("dot"))
    dots = written(products.join(least.hint("merge"), "key").where(F.col("dot") / F.col("least") >= threshold - 1e-3).drop("least"), f"{folder}/dots")
    keys = dots.select("key").distinct()
    chosen = written(marked(distinct, keys, "key").join(keys.hint("merge"), "key"), f"{folder}/chosen")  # the other units stay where they are
    others = chosen.select(F.explode("terms").alias("term")).distinct().join(F.broadcast(words), "term", "left_anti")
    idf = idf.union(idf_of(others, "df-units"))
    weighted = _vectors(chosen, ["key"], idf)
    unit_norm = weighted.groupBy("key").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("un"))
    scored = dots.join(unit_norm, "key").select("key", "license", F.round(F.col("dot") / F.col("un"), 4).alias("cosine")).where(F.col("cosine") >= threshold)
    best_unit = _salted(written(scored.groupBy("key").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("license").alias("l"))).alias("b")).select("key", F.col("b.l").alias("l"), F.col("b.c").alias("c")), f"{folder}/best"))
    salt = lambda *c: F.pmod(F.xxhash64(*c), F.lit(SALT)).cast("int").alias("salt")
    by_unit = held_units.select("digest", "key", salt("digest")).join(best_unit, ["key", "salt"])
    own = by_unit.groupBy("digest").agg(F.min(F.struct("c", "l")).alias("b")).select("digest", F.col("b.l").alias("l"), (-F.col("b.c")).alias("c"))
    said = F.regexp_extract("text", looping(SPDX), 1)
    files = base.select("doc_id", "path", "is_file", F.when(F.col("is_marked"), digest).alias("digest"), F.when(said != "", said).alias("said"), F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"), salt("doc_id", "path"))
    found = files.join(_salted(own), ["digest", "salt"], "left").select("doc_id", "path", "is_file", "dir", "salt", F.coalesce("said", "l").alias("own_license"), F.when(F.col("said").isNotNull(), F.lit(1.0)).otherwise(F.col("c")).alias("cosine"))
    holders = found.where("is_file and own_license is not null").groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), F.col("own_license").alias("l"))).alias("b")).select(F.col("dir").alias("up"), F.col("b.l").alias("up_license"))
    parts = F.split("dir", "/")
    ancestors = files.select("dir").distinct().select("dir", F.explode(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("up"))
    ancestors = ancestors.withColumn("salt", salt("dir"))
    nearest = ancestors.join(_salted(holders), ["up", "salt"]).groupBy("dir").agg(F.max(F.struct(F.length("up").alias("n"), F.col("up"), F.col("up_license"))).alias("b")).select("dir", F.col("b.up").alias("from_dir"), F.col("b.up_license").alias("up_license"))
    out = found.join(_salted(nearest), ["dir", "salt"], "left")
    takes = F.col("own_license").isNull()
    return out.select("doc_id", "path", "own_license", "cosine", F.coalesce("own_license", "up_license").alias("license"), F.when(takes, F.col("from_dir")).alias("inherited_from"))


def _term_list(text: str) -> list[str]:
    import re

    return re.findall(_TERM, text.lower())


#: Paths of the documents table, which has none: source/a<id div 2000>/b<id div 100>/<name>; every tenth is a license file, which sits in its leaf, or for each fifth and fiftieth of these one and two directories higher.
PATH_SQL = """case when doc_id % 10 = 0 then
  case when doc_id % 500 = 0 then concat(coalesce(source, ''), '/LICENSE-', doc_id)
       when doc_id % 50 = 0 then concat(coalesce(source, ''), '/a', cast(floor(doc_id / 2000) as bigint), '/LICENSE-', doc_id)
       else concat(coalesce(source, ''), '/a', cast(floor(doc_id / 2000) as bigint), '/b', cast(floor(doc_id / 100) as bigint), '/LICENSE-', doc_id) end
  else concat(coalesce(source, ''), '/a', cast(floor(doc_id / 2000) as bigint), '/b', cast(floor(doc_id / 100) as bigint), '/doc-', doc_id) end"""


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, path=F.expr(PATH_SQL), license_file=F.expr("doc_id % 10 = 0"))
