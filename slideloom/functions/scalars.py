"""Column functions on paths, names, queries and vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOCUMENT_EXTENSIONS = ("xlsx", "xls", "pptx", "ppt", "pdf", "docx", "doc")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp")
#: Ignored paths (fixed values): hidden parts, names anywhere in the path, endings.
IGNORED = (
    r"(^|[/\\])\.", "node_modules", r"\.git", r"\.vs", r"\.vscode", "bin", "obj", "Debug", "Release", r"\.tmp\z", r"~\$", r"\.lock\z", r"\.log\z", r"Thumbs\.db\z", r"\.DS_Store\z",
)


def clean_path(path: Column) -> Column:
    """Trimmed, without one pair of equal quotes, with ``.``, ``..`` and empty parts folded."""
    text = F.regexp_replace(path, r"^\s+|\s+$", "")
    text = F.regexp_replace(text, r"""^(["'])(.*)\1$""", "$2")
    absolute = F.startswith(text, F.lit("/"))
    parts = F.filter(F.split(text, "/"), lambda x: ~x.isin("", "."))
    folded = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, x: F.when(
            x == "..",
            F.when((F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(absolute, acc).otherwise(F.concat(acc, F.array(x))),
        ).otherwise(F.concat(acc, F.array(x))),
    )
    joined = F.array_join(folded, "/")
    return F.when(absolute, F.concat(F.lit("/"), joined)).otherwise(F.when(joined == "", F.lit(".")).otherwise(joined))


def slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def base_name(path: Column) -> Column:
    return F.substring_index(slashes(path), "/", -1)


def extension(path: Column) -> Column:
    """Lower-case extension without its dot; '' if there is none."""
    return F.lower(F.regexp_extract(base_name(path), r"\.([^.]+)$", 1))


def parent(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(slashes(path), r"^(.*)/[^/]*$", 1), "/+$", "")


def path_parts(df: DataFrame, path: str = "path") -> DataFrame:
    p = slashes(F.col(path))
    return df.withColumns({"dir": parent(p), "name": base_name(p), "ext": extension(p), "depth": F.size(F.split(p, "/")) - 1, "display": F.when(base_name(p) == "", p).otherwise(base_name(p))})


def is_supported_document(path: Column) -> Column:
    return extension(path).isin(*DOCUMENT_EXTENSIONS)


def classify_document(path: Column, strict_case: bool = False) -> Column:
    """excel, powerpoint, pdf, word or null; ``strict_case`` only knows lower-case extensions."""
    ext = F.regexp_extract(base_name(path), r"\.([^.]+)$", 1)
    ext = ext if strict_case else F.lower(ext)
    return F.when(ext.isin("xlsx", "xls"), "excel").when(ext.isin("pptx", "ppt"), "powerpoint").when(ext == "pdf", "pdf").when(ext.isin("docx", "doc"), "word")


def drop_ignored(df: DataFrame, path: str = "path") -> DataFrame:
    return df.where(~F.col(path).rlike("|".join(IGNORED)))


def add_slide_identity(df: DataFrame) -> DataFrame:
    n = F.col("slide_number").cast("string")
    return df.withColumns({"slide_id": F.concat("file_name", F.lit("_slide_"), n), "slide_text": F.concat(F.lit("Slide "), n, F.lit(" from "), "file_name")})


def validate_vectors(df: DataFrame, dim: int, vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(rows with a vector of ``dim`` numbers, the others with a reason)."""
    size = F.size(vector)
    reason = F.when(F.col(vector).isNull(), "missing").when(size == 0, "empty").when(size != dim, "dimension")
    judged = df.withColumn("reason", reason)
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL")


def normalize_query(query: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(query), r"(?U)\s+", " "), "^ | $", "")


def query_hash(query: Column) -> Column:
    return F.sha2(normalize_query(query), 256)


def drop_blank_queries(df: DataFrame, query: str = "query") -> DataFrame:
    return df.where(F.length(normalize_query(F.col(query))) > 0)


def event_to_update(df: DataFrame) -> DataFrame:
    action = F.when(F.col("type").isin("add", "addDir"), "add").when(F.col("type").isin("unlink", "unlinkDir"), "remove").otherwise("change")
    return df.withColumns({"action": action, "name": base_name(F.col("path")), "is_dir": F.col("type").isin("addDir", "unlinkDir")})


def should_auto_process(df: DataFrame) -> DataFrame:
    return df.where(F.col("type").isin("add", "change") & is_supported_document(F.col("path")))


def find_files(df: DataFrame, needle: str, ext: str = ".xlsx") -> DataFrame:
    name = F.lower(base_name(F.col("path")))
    out = df.where(F.endswith(name, F.lit(ext)) & F.contains(name, F.lit(needle.lower())))
    return out.where("NOT is_dir") if "is_dir" in df.columns else out


def percent_text(x: Column) -> Column:
    """A double as a percentage with one decimal, as JavaScript's toFixed(1) has it: the decimal nearest to the exact binary value, ties away from zero.

    Only .25 and .75 are ties; format_number takes the even neighbour, which is the lower one for .25.
    """
    up = F.when(F.abs(x) * 4 % 4 == 1, 0.05 * F.signum(x)).otherwise(0.0)
    return F.concat(F.call_function("format_number", x + up, F.lit("0.0")), F.lit("%"))


def shape_hits(df: DataFrame) -> DataFrame:
    score = F.coalesce(F.col("score"), F.lit(0.0))
    return df.withColumns({
        "file_path": F.coalesce("file_path", F.lit("")), "slide_number": F.coalesce("slide_number", F.lit(0)), "score": score,
        "score_text": percent_text(score * 100),
    })


_VERSION = r"(?i)[\s_-]?v(\d+)\z"


def name_base(name: Column) -> Column:
    """A file name without .pptx; what is before a version suffix, trimmed, if it has one."""
    bare = F.regexp_replace(name, r"(?i)\.pptx\z", "")
    return F.when(bare.rlike(_VERSION), F.regexp_replace(F.regexp_replace(bare, _VERSION, ""), r"(?U)^\s+|\s+\z", "")).otherwise(bare)


def name_version(name: Column) -> Column:
    """The version number of a file name, or null."""
    found = F.regexp_extract(F.regexp_replace(name, r"(?i)\.pptx\z", ""), _VERSION, 1)
    return F.when(found != "", found)


def name_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise((longest - F.levenshtein(a, b)) / longest)


def same_presentation(a: Column, b: Column) -> Column:
    """Whether two file names are versions of one presentation."""
    return same_base(F.lower(name_base(a)), name_version(a).isNotNull(), F.lower(name_base(b)), name_version(b).isNotNull())


def same_base(x: Column, va: Column, y: Column, vb: Column) -> Column:
    """:func:`same_presentation` of lower-case bases and whether they have versions."""
    s = name_similarity(x, y)
    return F.when(va & vb, s > 0.8).when(va | vb, s > 0.9).otherwise(x == y)


def relative_age(ts: Column, now: Column) -> Column:
    minutes = F.floor((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(ts.cast("timestamp"))) / 60)
    count = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return (
        F.when(minutes < 1, "Just now").when(minutes < 60, count(minutes, "m")).when(minutes < 1440, count(F.floor(minutes / 60), "h"))
        .when(minutes < 10080, count(F.floor(minutes / 1440), "d")).otherwise(F.date_format(ts, "yyyy-MM-dd"))
    )


def non_ascii_report(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row for each character above U+007F; lines without any are dropped before they are split.

    A text of bytes that are no UTF-8 gives one row instead, with char "Could not decode file" and no places.  A binary column is taken as UTF-8.
    """
    given = df.select(F.col(key), F.col(text).cast("string").alias("_text"))
    good = F.coalesce(F.is_valid_utf8("_text"), F.lit(True))
    lines = given.where(good).select(key, F.posexplode(F.split("_text", "\n")).alias("line_at", "line")).where(F.col("line").rlike(r"[^\x00-\x7F]"))
    chars = lines.select(key, (F.col("line_at") + 1).alias("line_no"), "line", F.posexplode(F.split("line", "")).alias("char_at", "char")).where(F.col("char").rlike(r"[^\x00-\x7F]"))
    code = F.lower(F.lpad(F.hex(F.ascii("char")), 4, "0"))
    found = chars.select(key, "line_no", (F.col("char_at") + 1).alias("column_no"), "char", F.concat(F.lit("U+"), code).alias("code"), F.trim("line").alias("line"))
    none = F.lit(None).cast("int")
    broken = given.where(~good).select(key, none.alias("line_no"), none.alias("column_no"), F.lit("Could not decode file").alias("char"), F.lit("").alias("code"), F.lit("").alias("line"))
    return found.union(broken)
