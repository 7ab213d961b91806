"""Page facts mapped to a caller's JSON Schema, by a plan made on the driver."""

from __future__ import annotations

import hashlib
import hmac
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Names under which the same fact is declared.
SYNONYMS = {
    "title": ("headline", "name"), "author": ("byline", "creator"), "published": ("datepublished", "publicationdate", "date"),
    "price": ("amount", "cost"), "brand": ("manufacturer",), "sku": ("mpn", "articlenumber"), "description": ("summary", "abstract"),
}
PRECEDENCE = {"fetch": 0, "meta": 1, "type": 2, "product": 3, "label": 4, "declared": 5}


def label_key(x: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(x, r"[^\p{L}\p{N}]", ""))


def base_key(x: Column) -> Column:
    """The same without bracketed parts."""
    return label_key(F.regexp_replace(x, r"[(\[{][^)\]}]*[)\]}]", ""))


def compile_schema(schema: dict) -> list[dict]:
    """Top-level fields of a schema: ``key, type, nullable, required``; references and unions
    with null are folded; unknown types are refused."""
    defs = schema.get("$defs", schema.get("definitions", {}))

    def fold(s: dict, depth: int = 0) -> tuple[str, bool]:
        if depth > 20:
            raise ValueError("references run in a circle")
        if "$ref" in s:
            return fold(defs[s["$ref"].rsplit("/", 1)[-1]], depth + 1)
        for k in ("anyOf", "oneOf"):
            if k in s:
                rest = [x for x in s[k] if x.get("type") != "null"]
                if len(rest) != 1:
                    raise ValueError("only unions with null are read")
                return fold(rest[0], depth + 1)[0], len(rest) < len(s[k])
        t = s.get("type", "string")
        if isinstance(t, list):
            rest = [x for x in t if x != "null"]
            return rest[0], len(rest) < len(t)
        if t not in ("string", "number", "integer", "boolean"):
            raise ValueError(f"type {t} is not mapped")
        return t, False

    out = []
    for key, s in schema.get("properties", {}).items():
        t, nullable = fold(s)
        out.append({"key": key, "type": t, "nullable": nullable, "required": key in schema.get("required", [])})
    return out


def candidates(values: DataFrame, plan: list[dict]) -> DataFrame:
    """``values`` (``page_id, pos, name, value, source``) joined to the schema's keys: exact
    label keys before those without brackets, then synonyms; the caller's keys are few and
    broadcast."""
    rows = []
    for f in plan:
        key = "".join(c for c in f["key"].lower() if c.isalnum())
        rows.append((f["key"], key, 0))
        rows += [(f["key"], s, 2) for s in SYNONYMS.get(key, ())]
    keys = F.broadcast(values.sparkSession.createDataFrame(rows, "key string, k string, how int"))
    exact = values.withColumn("k", label_key(F.col("name"))).withColumn("bare", F.lit(0))
    base = values.withColumn("k", base_key(F.col("name"))).withColumn("bare", F.lit(1))
    return exact.unionByName(base).join(keys, "k").withColumn("rank", F.col("how") + F.col("bare")).drop("bare", "how", "k")


def mapped(pages: DataFrame, values: DataFrame, schema: dict) -> DataFrame:
    """``page_id, data, state, issues``: JSON data by the schema; per key the best candidate
    of source precedence, match and position. Numbers are read from one-amount strings. A
    nullable key without a value is null with an issue, a required one ``missing_required``,
    two unequal best candidates ``ambiguous``."""
    plan = compile_schema(schema)
    order = F.element_at(F.create_map(*(F.lit(x) for kv in PRECEDENCE.items() for x in kv)), F.col("source"))
    c = candidates(values, plan).withColumn("place", F.struct(F.coalesce(order, F.lit(9)).alias("o"), F.col("rank")))
    w = Window.partitionBy("page_id", "key")
    best = c.withColumn("top", F.min("place").over(w)).where("place = top")
    per = best.groupBy("page_id", "key").agg(F.min_by("value", "pos").alias("value"), (F.count_distinct("value") > 1).alias("ambiguous"))
    wide = per.groupBy("page_id").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("got"),
        F.collect_set(F.when(F.col("ambiguous"), F.col("key"))).alias("unsure"),
    )
    joined = pages.select("page_id").join(wide, "page_id", "left")
    parts, issues, missing = [], [], F.lit(False)
    for f in plan:
        raw = F.try_element_at("got", F.lit(f["key"]))
        unsure = F.coalesce(F.array_contains("unsure", f["key"]), F.lit(False))
        value = F.when(~unsure, raw)
        if f["type"] in ("number", "integer"):
            amount = F.regexp_extract(value, r"^[^\d\-+]*([\-+]?\d[\d,]*(?:\.\d+)?)[^\d]*$", 1)
            value = F.regexp_replace(amount, ",", "").try_cast("double")
            value = value.try_cast("long") if f["type"] == "integer" else value
        elif f["type"] == "boolean":
            value = F.when(F.lower(value).isin("true", "yes", "1"), True).when(F.lower(value).isin("false", "no", "0"), False)
        parts.append(value.alias(f["key"]))
        issue = (
            F.when(unsure, "ambiguous")
            .when(raw.isNotNull() & value.isNull(), "not_convertible")
            .when(raw.isNull() & F.lit(f["required"] and not f["nullable"]), "missing_required")
            .when(raw.isNull() & F.lit(f["nullable"]), "null_filled")
        )
        issues.append(F.when(issue.isNotNull(), F.concat(F.lit(f"{f['key']}: "), issue)))
        if f["required"] and not f["nullable"]:
            missing = missing | value.isNull()
    found = F.filter(F.array(*issues), lambda x: x.isNotNull())
    state = F.when(missing, "incomplete").otherwise("complete")
    return joined.select("page_id", F.to_json(F.struct(*parts)).alias("data"), state.alias("state"), found.alias("issues"))


def canonical_json(x) -> str:
    """JSON with sorted keys (by UTF-16 units) and without white space."""
    if isinstance(x, dict):
        keys = sorted(x, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(json.dumps(k, ensure_ascii=False) + ":" + canonical_json(x[k]) for k in keys) + "}"
    if isinstance(x, list):
        return "[" + ",".join(map(canonical_json, x)) + "]"
    if isinstance(x, float) and x == int(x) and abs(x) < 1e21:
        return str(int(x))
    return json.dumps(x, ensure_ascii=False)


@F.pandas_udf(StringType())
def canonical(text: pd.Series) -> pd.Series:
    """Canonical form of JSON texts; null for what is not JSON."""

    def one(t):
        try:
            return canonical_json(json.loads(t))
        except (TypeError, ValueError):
            return None

    return text.map(one)


def cache_key(url: Column, options: Column) -> Column:
    """Hash of a URL without fragment and its canonical options."""
    return F.sha2(F.concat_ws("\n", F.regexp_replace(url, r"#.*$", ""), canonical(options)), 256)


def signature(secret: str, timestamp: Column, body: Column) -> Column:
    """HMAC-SHA256 of ``timestamp.body`` as lower hex, by Arrow batches."""

    @F.pandas_udf(StringType())
    def sign(t: pd.Series, b: pd.Series) -> pd.Series:
        key = secret.encode()
        return pd.Series([hmac.new(key, f"{x}.{y}".encode(), hashlib.sha256).hexdigest() for x, y in zip(t, b)], dtype="object")

    return sign(timestamp.cast("string"), body)


def evidence(rows: DataFrame) -> DataFrame:
    """The flat provenance row of each result, its columns fixed by version."""
    return rows.select(
        F.lit(1).alias("version"), "url", "final_url", "status", "reason", "http_status", "lane", "robots_decision", "raw_sha256",
        F.lower("markdown_sha256").alias("markdown_sha256"), "extractor", "source_commit", "cache_state", "verification", "markdown_file",
    )


def locate(text: Column, value: Column) -> Column:
    """Where a claimed value stands in a text, from 1, as written or with other white space;
    0 if it does not."""
    exact = F.position(value, text)
    loose = F.position(F.lower(F.regexp_replace(value, r"\s+", " ")), F.lower(F.regexp_replace(text, r"\s+", " ")))
    return F.when(exact > 0, exact).otherwise(loose)
