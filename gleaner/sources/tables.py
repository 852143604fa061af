"""Readers and writers of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flattened(df: DataFrame) -> DataFrame:
    """Struct fields as columns joined by _, arrays and maps as JSON text."""

    def walk(schema: T.StructType, path: str, name: str) -> list[Column]:
        out = []
        for f in schema.fields:
            at, label = f"{path}`{f.name}`", f"{name}{f.name}"
            if isinstance(f.dataType, T.StructType):
                out += walk(f.dataType, f"{at}.", f"{label}_")
            elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
                out.append(F.to_json(F.col(at)).alias(label))
            else:
                out.append(F.col(at).alias(label))
        return out

    return df.select(*walk(df.schema, "", ""))


def united(*frames: DataFrame) -> DataFrame:
    """Rows of all frames over the sorted union of their columns; what a frame lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.select(*sorted(out.columns))


def with_meta(df: DataFrame, engine: str, quality: Column, at: Column) -> DataFrame:
    return df.withColumn("_meta", F.struct(F.lit(engine).alias("engine"), quality.alias("quality"), at.alias("scraped_at")))


def envelope(df: DataFrame, engine: str) -> DataFrame:
    """One JSON text per row, under data, with the engine beside it."""
    return df.select(F.to_json(F.struct(F.lit(engine).alias("engine"), F.struct(*[F.col(c) for c in df.columns]).alias("data"))).alias("value"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    flat = flattened(df)
    flat.select(*sorted(flat.columns)).write.mode("overwrite").option("header", True).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    flattened(df).write.mode("overwrite").option("compression", "zstd").parquet(path)


def write_text_columns(df: DataFrame, path: str) -> None:
    """Every column as text, as a table store without types keeps it."""
    flat = flattened(df)
    flat.select(*[F.col(c).cast("string").alias(c) for c in flat.columns]).write.mode("overwrite").parquet(path)


def primitive(df: DataFrame) -> bool:
    """Whether every column holds single values, so that CSV loses nothing."""
    return not any(isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) for f in df.schema.fields)


def write_legacy(df: DataFrame, path: str) -> list[str]:
    """JSON lines, and CSV only where every value is primitive; the formats written."""
    write_jsonl(df, f"{path}/jsonl")
    if not primitive(df):
        return ["jsonl"]
    write_csv(df, f"{path}/csv")
    return ["jsonl", "csv"]


WRITERS = {"jsonl": write_jsonl, "csv": write_csv, "parquet": write_parquet, "text": write_text_columns}


def fan_out(df: DataFrame, path: str, *formats: str) -> None:
    """Several sinks from one computation."""
    held = df.persist()
    try:
        for f in WRITERS if "all" in formats else formats:
            WRITERS[f](held, f"{path}/{f}")
    finally:
        held.unpersist()


def split_bad(df: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad ones with their errors for the dead-letter sink."""
    marked = df.withColumn("_errors", errors)
    return marked.where(F.size("_errors") == 0).drop("_errors"), marked.where(F.size("_errors") > 0)


def sitemap_entries(xml: Column) -> Column:
    """array<struct<loc,lastmod,priority>> of a sitemap's entries (name spaces are left out first)."""
    bare = F.regexp_replace(xml, r'\sxmlns(?::\w+)?="[^"]*"', "")
    blocks = F.regexp_extract_all(bare, F.lit(r"(?s)<(?:url|sitemap)>(.*?)</(?:url|sitemap)>"), F.lit(1))
    field = lambda b, n: F.nullif(F.trim(F.regexp_extract(b, rf"(?s)<{n}>(.*?)</{n}>", 1)), F.lit(""))
    return F.transform(blocks, lambda b: F.struct(field(b, "loc").alias("loc"), field(b, "lastmod").alias("lastmod"), field(b, "priority").try_cast("double").alias("priority")))


def robots_sitemaps(text: Column) -> Column:
    """Addresses on the Sitemap lines of a robots file."""
    lines = F.filter(F.split(text, "\r?\n"), lambda x: F.lower(F.trim(x)).startswith("sitemap:"))
    return F.transform(lines, lambda x: F.trim(F.substring(F.trim(x), 9, 10_000)))


def robots_allow(text: Column, path: Column) -> Column:
    """Whether the longest rule of a robots file's * group that begins the path allows it."""
    group = F.regexp_extract(F.concat(text, F.lit("\nUser-agent: end")), r"(?si)user-agent:\s*\*\s*\n(.*?)(?=\nuser-agent:)", 1)
    rules = F.filter(F.split(group, "\r?\n"), lambda x: F.lower(x).rlike(r"^\s*(allow|disallow):\s*\S"))
    told = F.transform(rules, lambda x: F.struct(F.length(F.trim(F.substring_index(x, ":", -1))).alias("n"), F.lower(F.trim(x)).startswith("allow").alias("ok"), F.trim(F.substring_index(x, ":", -1)).alias("p")))
    best = F.array_max(F.filter(told, lambda r: path.startswith(r["p"])))
    return F.coalesce(best["ok"], F.lit(True))
