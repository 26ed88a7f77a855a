"""Registered queries of the detectors, each against SQL: numbers with check digits, and labels before and around values.

Their texts are made of the keys of orders, so that half of the candidates pass a check or stand behind a label and the SQL
can say which."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkspan.functions import checksums
from inkspan.operators import detectors

from .catalog import query, table

c = F.col


def _detected(spark, texts: DataFrame, name: str, language: str = "en") -> DataFrame:
    pages = texts.select(c("o_orderkey").alias("doc_id"), F.lit(1).alias("page"), "text", F.array(F.lit(language)).alias("languages"))
    found = detectors.detect(pages, [name], languages="languages")
    return found.select(c("doc_id").alias("o_orderkey"), "detector", "category", F.round("confidence", 2).alias("confidence"), "start", "end", c("text").alias("hit"))


def _pad(v: Column, n: int) -> Column:
    return F.lpad(v.cast("long").cast("string"), n, "0")


_K = """SELECT o_orderkey AS k, lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS s1, lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0') AS s2, lpad(CAST(o_orderkey * 7 % 10000 AS VARCHAR), 4, '0') AS s3,
  lpad(CAST(o_orderkey * 7919 % 100000000 AS VARCHAR), 8, '0') AS dni, substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST((o_orderkey * 7919 % 100000000 % 23 + o_orderkey % 2) % 23 + 1 AS INT), 1) AS letter,
  '1' || lpad(CAST(o_orderkey * 104729 % 1000000000000 AS VARCHAR), 12, '0') AS nir, o_orderkey * 1000003 + o_custkey AS bban FROM orders"""


@query(f"""WITH k AS ({_K}), i AS (SELECT k, lpad(CAST(bban AS VARCHAR), 18, '0') AS b, lpad(CAST((98 - (CAST(bban AS HUGEINT) * 1000000 + 131400) % 97 + k % 2) % 100 AS VARCHAR), 2, '0') AS chk FROM k),
  n AS (SELECT k, nir, lpad(CAST((97 - CAST(nir AS BIGINT) % 97 + k % 2) % 100 AS VARCHAR), 2, '0') AS chk FROM k)
SELECT k AS o_orderkey, 'us-social-security' AS detector, 'government-id' AS category, CAST(0.95 AS DOUBLE) AS confidence, 4 AS start, 15 AS "end", s1 || '-' || s2 || '-' || s3 AS hit FROM k WHERE s1 NOT IN ('000', '666') AND s1 < '900' AND s2 <> '00' AND s3 <> '0000'
UNION ALL SELECT k, 'es-national-id', 'government-id', 0.92, 4, 13, dni || letter FROM k WHERE k % 2 = 0
UNION ALL SELECT k, 'fr-social-security', 'government-id', 0.92, 4, 19, nir || chk FROM n WHERE 97 - CAST(nir AS BIGINT) % 97 = CAST(chk AS BIGINT)
UNION ALL SELECT k, 'iban', 'bank-account', 0.93, 4, 31, h FROM (SELECT k, b, chk, 'DE' || chk || ' ' || substr(b, 1, 4) || ' ' || substr(b, 5, 4) || ' ' || substr(b, 9, 4) || ' ' || substr(b, 13, 4) || ' ' || substr(b, 17, 2) AS h FROM i)
  WHERE (CAST(b AS HUGEINT) * 1000000 + 131400 + CAST(chk AS HUGEINT)) % 97 = 1""")
def checked_numbers(spark, d):
    """Social security numbers, DNI, NIR and IBAN: every other check digit of the last three is wrong."""
    o = table(spark, d, "orders")
    k, u = c("o_orderkey"), c("o_custkey")
    say = lambda v: F.concat(F.lit("see "), v, F.lit(", please"))
    big = lambda v: v.cast("decimal(38,0)")
    ssn = F.concat(_pad(k % 1000, 3), F.lit("-"), _pad(u % 100, 2), F.lit("-"), _pad(k * 7 % 10000, 4))
    dni = F.concat(_pad(k * 7919 % 100000000, 8), F.substring(F.lit(checksums.DNI_LETTERS), ((k * 7919 % 100000000 % 23 + k % 2) % 23 + 1).cast("int"), F.lit(1)))
    nir = F.concat(F.lit("1"), _pad(k * 104729 % 1000000000000, 12))
    nir = F.concat(nir, _pad((97 - nir.cast("long") % 97 + k % 2) % 100, 2))
    bban = k * 1000003 + u
    b, chk = _pad(bban, 18), _pad((98 - (big(bban) * 1000000 + 131400) % 97 + k % 2) % 100, 2)
    iban = F.concat(F.lit("DE"), chk, *(x for i in range(1, 18, 4) for x in (F.lit(" "), F.substring(b, i, 4))))
    kinds = [("us-social-security", ssn, "en"), ("es-national-id", dni, "es"), ("fr-social-security", nir, "fr"), ("iban", iban, "en")]
    return reduce(DataFrame.unionByName, (_detected(spark, o.select("o_orderkey", say(v).alias("text")), n, lang) for n, v, lang in kinds))


# (detector, language, before the value, value, what stands instead of the label in every other row, category, confidence)
_LABELLED = [
    ("labelled-account-number", "en", "Account no: ", "n8", "Some number: ", "bank-account", 0.7),
    ("labelled-account-number", "de", "Kontonummer ", "n8", "Irgendeine ", "bank-account", 0.7),
    ("labelled-date-of-birth", "en", "Date of birth: ", "date", "Delivered on: ", "date-of-birth", 0.72),
    ("labelled-date-of-birth", "fr", "Date de naissance : ", "date", "Date de livraison : ", "date-of-birth", 0.72),
    ("labelled-reference", "en", "Customer number: ", "ref", "Nothing of a kind: ", "customer-id", 0.68),
    ("labelled-reference", "es", "cliente ", "ref", "nada ", "customer-id", 0.68),
    ("labelled-national-id", "de", "Reisepass ", "n8", "Fahrrad ", "government-id", 0.9),
    ("credential", "en", "key ", "key", "key x", "api-key", 0.96),
    ("link-with-token", "en", "at ", "token", "at ", "url", 0.55),
    ("phone-number", "en", "call ", "phone", "call 0", "phone", 0.88),
    ("street-address", "en", "at ", "street", "at ", "address", 0.6),
]
_VALUE = {"n8": "'1' || n", "date": "'12/03/19' || right(n, 2)", "ref": "'AB-' || n", "key": "'sk_live_' || 'aB3' || n || n", "token": "'https://x.example/a' || CASE WHEN odd THEN '?page=' ELSE '?token=' END || n", "phone": "'+34 6' || substr(n, 1, 2) || ' ' || substr(n, 3, 3) || ' ' || CASE WHEN odd THEN '' ELSE '123' END", "street": "CAST(k % 900 + 1 AS STRING) || ' Long ' || CASE WHEN odd THEN 'River' ELSE 'Street' END"}


def _labelled_sql(i: int) -> str:
    name, _, label, value, other, category, confidence = _LABELLED[i]
    at = len(label)
    return f"""SELECT k AS o_orderkey, {i} AS form, '{name}' AS detector, '{category}' AS category, CAST({confidence} AS DOUBLE) AS confidence, {at} AS start, {at} + length(v) AS "end", v AS hit FROM (SELECT k, {_VALUE[value]} AS v FROM t WHERE NOT odd)"""


@query("WITH t AS (SELECT o_orderkey AS k, lpad(CAST(o_orderkey % 10000000 AS VARCHAR), 7, '0') AS n, o_orderkey % 2 = 1 AS odd FROM orders) " + " UNION ALL ".join(_labelled_sql(i) for i in range(len(_LABELLED))))
def labelled_values(spark, d):
    """Values behind labels in four languages, keys, links, numbers and streets; odd rows lack what makes them one."""
    k = c("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", k.alias("k"), _pad(k % 10000000, 7).alias("n"), (k % 2 == 1).alias("odd"))
    out = []
    for i, (name, language, label, value, other, _, _) in enumerate(_LABELLED):
        text = F.concat(F.when(c("odd"), F.lit(other)).otherwise(F.lit(label)), F.expr(_VALUE[value]))
        out.append(_detected(spark, rows.select("o_orderkey", text.alias("text")), name, language).withColumn("form", F.lit(i)))
    return reduce(DataFrame.unionByName, out)
