"""Substitution and removal: methods, surrogates, cutting text and cells, verification, vault and restoring."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from inkspan.functions import fixed
from inkspan.functions.text import known_category, normalize_value, ws_trim

from .matching import sweep, value_places
from .records import RASTER
from .spans import merged_runs


def _map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in pairs.items() for x in kv))


def accepted(redactions: DataFrame) -> DataFrame:
    return redactions.where(F.col("status") == "accepted")


def accepted_values(redactions: DataFrame) -> DataFrame:
    """doc_id, value: distinct trimmed texts of two characters or more that are not whole rows or columns."""
    rows = accepted(redactions).where(~F.col("type").isin("row", "column")).select("doc_id", ws_trim(F.col("text")).alias("value"))
    return rows.where(F.length("value") >= 2).distinct()


def carries_text(kind: Column, text: Column) -> Column:
    return ~kind.isin("face", "row", "column") & (F.length(ws_trim(F.coalesce(text, F.lit("")))) >= 2)


def resolve_method(category: Column, method: Column, kind: Column, text: Column, overrides: dict[str, str] | None = None) -> Column:
    """What is done with a redaction: by its category's override, else its own method, if the category allows that."""
    category = known_category(category)
    asked = F.coalesce(_map(overrides)[category], method) if overrides else method
    allowed = F.split(_map({k: v[0] for k, v in fixed.CATEGORIES.items()})[category], " ")
    return F.when(asked.isNotNull() & carries_text(kind, text) & F.array_contains(allowed, asked), asked).otherwise("mask")


def surrogates(redactions: DataFrame, short: bool = False, scope: Sequence[str] = ("doc_id",)) -> DataFrame:
    """scope, normalized, value, category, method, surrogate of every accepted value (columns doc_id, seq, type, text,
    category, method). A value has one method, the strongest asked for; names are numbered by stem in the binary order of
    folded values, masked ones are not numbered. ``short``: ciphers have names too."""
    keys = list(scope)
    rows = accepted(redactions).where(carries_text(F.col("type"), F.col("text")))
    rows = rows.withColumn("_m", resolve_method(F.col("category"), F.col("method"), F.col("type"), F.col("text"))).withColumn("normalized", normalize_value(F.col("text")))
    rank = _map({m: i for i, m in enumerate(fixed.STRENGTH)})
    values = rows.groupBy(*keys, "normalized").agg(F.min_by("text", "seq").alias("value"), F.min_by("category", "seq").alias("category"), F.min_by("_m", rank[F.col("_m")]).alias("method"))
    named = F.col("method").isin("pseudonymize", "tokenize") | (F.lit(short) & (F.col("method") == "encrypt"))
    stem = F.when(F.col("method") == "encrypt", "ENC").otherwise(_map({k: v[1] for k, v in fixed.CATEGORIES.items()})[known_category(F.col("category"))])
    values = values.withColumn("_stem", F.when(named, stem))
    number = F.row_number().over(Window.partitionBy(*keys, "_stem").orderBy("normalized")).cast("string")
    name = F.concat("_stem", F.lit("_"), F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number))
    return values.withColumn("surrogate", F.when(named, name)).drop("_stem")


def encrypt_inline(value: Column, key: Column) -> Column:
    """AES-GCM with a random IV as ENC[base64url]; differs from run to run."""
    return F.concat(F.lit("ENC["), F.regexp_replace(F.translate(F.base64(F.aes_encrypt(value, key, F.lit("GCM"))), "+/", "-_"), "[=\\r\\n]", ""), F.lit("]"))


def decrypt_inline(token: Column, key: Column) -> Column:
    body = F.translate(F.regexp_extract(token, r"\AENC\[([A-Za-z0-9_-]+)\]\z", 1), "-_", "+/")
    return F.aes_decrypt(F.unbase64(body), key, F.lit("GCM")).cast("string")


def cut_text(pages: DataFrame, ranges: DataFrame, keys: Sequence[str], label: str = fixed.LABEL) -> DataFrame:
    """pages with redacted_text: each merged range (keys, start, end, replacement) as its replacement. Where ranges merge,
    a mask (null replacement) beats surrogates, and two different surrogates give the label too."""
    k = list(keys)
    one = (F.count("*") == F.count("replacement")) & (F.count_distinct("replacement") == 1)
    parts = merged_runs(ranges, k).groupBy(*k, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.when(one, F.first("replacement")).otherwise(label).alias("w"))
    lists = parts.groupBy(*k).agg(F.sort_array(F.collect_list(F.struct("start", "end", "w"))).alias("_cuts"))
    fold = """aggregate(_cuts, struct(cast(0 as int) as at, cast('' as string) as out),
        (s, c) -> struct(cast(least(c.end, length(text)) as int) as at, concat(s.out, substring(text, s.at + 1, greatest(least(c.start, length(text)) - s.at, 0)), c.w) as out),
        s -> concat(s.out, substring(text, s.at + 1)))"""
    return pages.join(lists, k, "left").withColumn("redacted_text", F.when(F.col("_cuts").isNull(), F.col("text")).otherwise(F.expr(fold))).drop("_cuts")


def redact_cells(cells: DataFrame, orders: DataFrame, values: DataFrame, label: str = fixed.LABEL) -> DataFrame:
    """cells (doc_id, row, col, value) with redacted: by whole column (never the header row), row or cell, else each
    accepted value (doc_id, value, replacement if there) swept out of the field. orders: doc_id, type, row, col. Empty stays."""
    o = orders.select("doc_id", "type", F.col("row").alias("_r"), F.col("col").alias("_c"))
    hit = F.expr("(type = 'column' and _c = col and row > 1) or (type = 'row' and _r = row) or (type = 'cell' and _r = row and _c = col)")
    whole = cells.join(o, "doc_id").where(hit).select("doc_id", "row", "col").distinct().withColumn("_all", F.lit(True))
    rows = sweep(cells.join(whole, ["doc_id", "row", "col"], "left"), values, "value", label, "_swept")
    return rows.withColumn("redacted", F.when(F.length(F.coalesce("value", F.lit(""))) == 0, F.col("value")).when(F.col("_all"), F.lit(label)).otherwise(F.col("_swept"))).drop("_all", "_swept")


def verify(output: DataFrame, values: DataFrame, own: DataFrame | None = None, least: int = fixed.SEARCHED_LENGTH) -> DataFrame:
    """doc_id, value: accepted values of ``least`` characters or more still in the output (doc_id, text), whatever the case.
    A document's own surrogates (doc_id, surrogate) are blanked first. An empty result lets an export pass."""
    out = output.select("doc_id", "text")
    if own is not None:
        out = sweep(out, own.where("surrogate is not null").select("doc_id", F.col("surrogate").alias("value"), F.lit(" ").alias("replacement")), to="_t").select("doc_id", F.col("_t").alias("text"))
    v = values.where(F.length("value") >= least).select("doc_id", "value").distinct()
    return value_places(out, v, every=True, keep=["doc_id"], once=True).select("doc_id", "value").distinct()


class ExportVerificationError(RuntimeError):
    pass


def assert_clean(leaks: DataFrame) -> None:
    """Refuse an export that still holds an accepted value."""
    if (n := leaks.count()) > 0:
        raise ExportVerificationError(f"{n} accepted values are still in the output")


def vault(named: DataFrame) -> DataFrame:
    """doc_id, vault: JSON of what tokenised values stand for, by surrogate."""
    rows = named.where("method = 'tokenize' and surrogate is not null").select("doc_id", F.struct("surrogate", "method", "category", "value").alias("e"))
    return rows.groupBy("doc_id").agg(F.to_json(F.struct(F.lit(1).alias("version"), F.sort_array(F.collect_list("e")).alias("entries"))).alias("vault"))


def restore(output: DataFrame, vaults: DataFrame) -> DataFrame:
    """output with restored_text and outcome (ok, nothing): tokens of the vault put back, the longest first."""
    kind = "struct<version:int,entries:array<struct<surrogate:string,method:string,category:string,value:string>>>"
    v = vaults.select("doc_id", F.from_json("vault", kind)["entries"].alias("_e"))
    rows = output.join(v, "doc_id", "left")
    ordered = "array_sort(coalesce(_e, array()), (a, b) -> length(b.surrogate) - length(a.surrogate))"
    rows = rows.withColumn("restored_text", F.expr(f"aggregate({ordered}, text, (t, e) -> replace(t, e.surrogate, e.value))"))
    return rows.withColumn("outcome", F.when(F.col("restored_text") == F.col("text"), "nothing").otherwise("ok")).drop("_e")


def restore_documents(output: DataFrame, vaults: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """output (doc_id, kind, text) with restored_text, outcome, restored and unresolved: what stands for values put back, in one
    pass over a text. vaults (doc_id, vault) as ``vault`` makes them; keys (doc_id, key): of inline ciphertexts.

    outcome: unsupported-format (a picture), no-key (ciphertexts without a key, or none of what there is could be read),
    nothing-to-restore, or ok; only with ok the text changes. A ciphertext that the key does not open stays as it is and is
    unresolved. What the vault names and the text has not is no failure; a surrogate must be there in its own case."""
    kind = "struct<entries:array<struct<surrogate:string,method:string,value:string>>>"
    entries = vaults.select("doc_id", F.explode(F.from_json("vault", kind)["entries"]).alias("e")).where("e.method = 'tokenize'").select("doc_id", F.col("e.surrogate").alias("value"), F.col("e.value").alias("replacement"))
    found = output.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(ENC\[[A-Za-z0-9_-]+\])")))).alias("value"))
    if keys is None:
        inline = found.select("doc_id", "value", F.lit(None).cast("string").alias("replacement"), F.lit(False).alias("_keyed"))
    else:
        body = F.unbase64(F.translate(F.regexp_extract("value", r"\AENC\[([A-Za-z0-9_-]+)\]\z", 1), "-_", "+/"))
        opened = F.try_aes_decrypt(body, F.col("key"), F.lit("GCM")).cast("string")
        inline = found.join(keys.select("doc_id", "key"), "doc_id", "left").select("doc_id", "value", F.when(F.col("key").isNotNull(), opened).alias("replacement"), F.col("key").isNotNull().alias("_keyed"))
    about = inline.groupBy("doc_id").agg((~F.bool_and("_keyed")).alias("_locked"), F.count_if(F.col("replacement").isNull()).alias("unresolved"))
    values = inline.where("replacement is not null").select("doc_id", "value", "replacement").unionByName(entries)
    values = values.join(output.select("doc_id", F.col("text").alias("_t")), "doc_id").where(F.contains("_t", "value")).select("doc_id", "value", "replacement")
    values = values.dropDuplicates(["doc_id", "value"])
    n = values.groupBy("doc_id").agg(F.count("*").alias("restored"))
    rows = sweep(output, values, to="_restored").join(about, "doc_id", "left").join(n, "doc_id", "left").fillna(0, ["unresolved", "restored"])
    locked, some = F.coalesce("_locked", F.lit(False)), F.col("restored") > 0
    outcome = F.when(F.col("kind").isin(*RASTER), "unsupported-format").when(locked, "no-key").when(some, "ok").when(F.col("unresolved") > 0, "no-key").otherwise("nothing-to-restore")
    rows = rows.withColumn("outcome", outcome)
    fine = F.col("outcome") == "ok"
    return rows.select(*output.columns, F.when(fine, F.col("_restored")).otherwise(F.col("text")).alias("restored_text"), "outcome", F.when(fine, F.col("restored")).otherwise(0).alias("restored"), "unresolved")


def variant_names(variants: DataFrame) -> DataFrame:
    """variants (doc_id, seq, base, extension) with file_name: ties within a document get -2, -3 and so on."""
    n = F.row_number().over(Window.partitionBy("doc_id", "base", "extension").orderBy("seq"))
    return variants.withColumn("file_name", F.concat("base", F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise(""), F.lit("."), F.col("extension")))
