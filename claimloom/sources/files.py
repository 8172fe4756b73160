"""Documents of JSON in and out, and the checks on them."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_document(spark: SparkSession, path: str, rows: str, schema: str) -> DataFrame:
    """The rows under a key of one JSON object; a missing file gives no rows, another kind of document an error."""
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], schema)
    doc = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    kinds = [r[0] for r in doc.select(F.schema_of_variant("v")).limit(2).collect()]
    if len(kinds) != 1 or not (kinds[0] or "").startswith("OBJECT"):
        raise ValueError(f"{path} isn't one JSON object")
    return spark.read.schema(f"`{rows}` array<struct<{', '.join(p.strip().replace(' ', ':', 1) for p in _columns(schema))}>>").option("multiLine", True).json(path).select(F.inline(rows))


def _columns(schema: str) -> list[str]:
    """The columns of a DDL schema, split at its outer commas."""
    out, depth, start = [], 0, 0
    for i, ch in enumerate(schema):
        depth += (ch in "<(") - (ch in ">)")
        if ch == "," and not depth:
            out.append(schema[start:i])
            start = i + 1
    return [*out, schema[start:]]


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """(group_name, post_title, discovered, valid) of a JSON array; elements that aren't objects stay, as not valid."""
    doc = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("v"))
    kinds = [r[0] for r in doc.select(F.schema_of_variant("v")).limit(2).collect()]
    if len(kinds) != 1 or not (kinds[0] or "").startswith("ARRAY"):
        raise ValueError(f"{path} isn't a JSON array")
    doc.createOrReplaceTempView("__posts")
    each = spark.sql("select e.value as v from __posts, lateral variant_explode(v) as e")
    text = lambda k: F.try_variant_get("v", f"$.{k}", "string").alias(k)
    return each.select(text("group_name"), text("post_title"), text("discovered"), F.schema_of_variant("v").startswith("OBJECT").alias("valid"))


def assert_arrays(document: dict, *keys: str) -> None:
    for k in keys:
        if not isinstance(document.get(k), list):
            raise ValueError(f"the document has no list {k}")


def write_document(path: str, value: dict) -> None:
    """A public document in one step: written beside its place, then moved there. Its size is that of a catalog."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=folder, prefix=".writing-")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(value, f, ensure_ascii=False, indent=2)
            f.write("\n")
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise


def replace_table(df: DataFrame, path: str, check: Callable[[DataFrame], None] | None = None) -> None:
    """A table in one step, also where ``df`` reads the one it replaces: staged, checked, then swapped by the file system."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target, staged, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, path + ".staged", path + ".old"))
    df.write.mode("overwrite").parquet(path + ".staged")
    if check:
        check(spark.read.parquet(path + ".staged"))
    fs = target.getFileSystem(conf)
    fs.delete(old, True)
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"{path} can't be set aside")
    if not fs.rename(staged, target):
        fs.rename(old, target)
        raise OSError(f"{path} can't be replaced")
    fs.delete(old, True)


def public(df: DataFrame, hidden: tuple[str, ...] = ("profile_url", "watchguard_profile_url")) -> DataFrame:
    """``df`` without the columns that aren't published, at any depth; hosts of the tracker itself are blanked."""
    low = {h.lower() for h in hidden}
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name.lower() in low:
            continue
        kind = f.dataType
        if kind.typeName() == "struct":
            gone = [x.name for x in kind.fields if x.name.lower() in low]
            c = c.dropFields(*gone) if gone and len(gone) < len(kind.fields) else c
        elif kind.typeName() == "array" and kind.elementType.typeName() == "struct":
            gone = [x.name for x in kind.elementType.fields if x.name.lower() in low]
            c = F.transform(c, lambda e, gone=gone: e.dropFields(*gone)) if gone and len(gone) < len(kind.elementType.fields) else c
        elif kind.typeName() == "map":
            c = F.map_filter(c, lambda k, v: ~F.lower(k).isin(*low))
        elif f.name == "source_host":
            c = F.when(~F.lower(c).contains("watchguard"), c)
        out.append(c.alias(f.name))
    return df.select(*out)
