"""Registered queries whose inputs are documents that no task holds whole, and others that need no sort of a key in one task."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkspan.operators import compare, matching, paging, provenance, ranks, records, redact, reports, rules, spans, upkeep
from inkspan.sources import atoms, splits
from inkspan.tables import shared_folder

from .catalog import query, table

c = F.col


@query("""WITH r AS (SELECT c_nationkey AS doc_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS row, c_custkey, c_name, c_mktsegment FROM customer)
SELECT doc_id, row, 1 AS col, CAST(c_custkey AS VARCHAR) AS value, false AS quoted FROM r
UNION ALL SELECT doc_id, row, 2, c_name || ', "' || c_mktsegment || '"' || chr(13) || chr(10) || 'end', true FROM r
UNION ALL SELECT doc_id, row, 4, c_mktsegment, false FROM r""")
def split_cells(spark, d):
    """A delimited document for each nation, in two pieces a customer that are cut anywhere: in quotes, line ends and names."""
    line = F.concat(c("c_custkey").cast("string"), F.lit(',"'), "c_name", F.lit(', ""'), "c_mktsegment", F.lit('""\r\nend",,'), "c_mktsegment", F.lit("\r\n"))
    rows = table(spark, d, "customer").select(c("c_nationkey").alias("doc_id"), "c_custkey", line.alias("_line"))
    cut = (c("c_custkey") * 7 % F.length("_line")).cast("int")
    halves = F.array(F.substring(c("_line"), F.lit(1), cut), F.substring(c("_line"), cut + 1, F.length("_line")))
    pieces = rows.select("doc_id", "c_custkey", F.posexplode(halves).alias("half", "text")).select("doc_id", (c("c_custkey") * 2 + c("half")).alias("seq"), "text")
    return splits.Grids(pieces, most=None).cells()


@query("""WITH m AS (SELECT coalesce(lang, 'none') AS doc_id, doc_id AS seq, 'Subject: d' || doc_id || chr(10) || chr(10) || coalesce(text, '') AS m FROM documents)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS message, md5(m || CASE WHEN right(m, 1) = chr(10) THEN '' ELSE chr(10) END) AS digest FROM m""")
def split_messages(spark, d):
    """A mailbox for each language, a piece for each document as a message."""
    body = F.concat(F.lit("Subject: d"), c("doc_id").cast("string"), F.lit("\n\n"), F.coalesce("text", F.lit("")))
    text = F.concat(F.lit("From MAILER-DAEMON Thu Jan  1 00:00:00 1970\n"), F.regexp_replace(body, r"(?dm)^(>*From )", ">$1"), F.when(body.endswith("\n"), "").otherwise("\n"), F.lit("\n"))
    pieces = table(spark, d, "documents").select(F.coalesce("lang", F.lit("none")).alias("doc_id"), c("doc_id").alias("seq"), text.alias("text"))
    return splits.Mailboxes(pieces, most=None).messages().select("doc_id", c("message").cast("long").alias("message"), F.md5("text").alias("digest"))


_MAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z]+"


@query(f"""WITH v AS (SELECT DISTINCT doc_id, lower(unnest(regexp_extract_all(text, '{_MAIL}'))) AS v FROM documents)
SELECT v.doc_id, v AS value, CAST((length(lower(text)) - length(replace(lower(text), v, ''))) / length(v) AS BIGINT) AS n FROM v JOIN documents d ON v.doc_id = d.doc_id""")
def own_values(spark, d):
    """How often each document's own addresses occur in it, within longer ones too."""
    docs = table(spark, d, "documents")
    values = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"({_MAIL})"))).alias("value")).distinct()
    return matching.value_places(docs.select("doc_id", "text"), values, alone=True).groupBy("doc_id", F.lower("value").alias("value")).agg(F.count("*").alias("n"))


_RUN = {
    "g": ("range(0, 6)", "(doc_id * 37 + k * 101) % (n - 40)", "5 + (doc_id + k) % 23"),
    "a": ("range(0, 8)", "(doc_id * 37 + k * 101) % (n - 40) + (k % 3) * 2 - 2", "9 + (doc_id * 3 + k) % 19"),
    "b": ("range(0, 8)", "(doc_id * 37 + k * 101) % (n - 40) + doc_id % 4", "3 + k * 4"),
}
_SPANS = ", ".join(f'{name} AS (SELECT doc_id, n, k, s AS "start", s + {size} AS "end" FROM (SELECT doc_id, n, k, {start} AS s FROM d, (SELECT unnest({ks}) AS k)))' for name, (ks, start, size) in _RUN.items())


@query(f"""WITH d AS (SELECT doc_id, text, length(text) AS n FROM documents WHERE length(text) >= 200), {_SPANS},
  pa AS (SELECT DISTINCT doc_id, unnest(range(greatest("start", 0), least("end", n))) AS p FROM a), pb AS (SELECT DISTINCT doc_id, unnest(range(greatest("start", 0), least("end", n))) AS p FROM b),
  pg AS (SELECT doc_id, k, unnest(range(greatest("start", 0), least("end", n))) AS p FROM g),
  every AS (SELECT doc_id, p FROM pa UNION SELECT doc_id, p FROM pb UNION SELECT doc_id, p FROM pg),
  filled AS (SELECT e.doc_id, p FROM every e JOIN d ON e.doc_id = d.doc_id WHERE unicode(substr(text, p + 1, 1)) NOT IN ({", ".join(map(str, compare.SPACES))})),
  lab AS (SELECT g.doc_id, g.k, coalesce(bool_and(pa.p IS NOT NULL) FILTER (WHERE filled.p IS NOT NULL), true) AS a, coalesce(bool_and(pb.p IS NOT NULL) FILTER (WHERE filled.p IS NOT NULL), true) AS b
    FROM g LEFT JOIN pg ON g.doc_id = pg.doc_id AND g.k = pg.k LEFT JOIN filled ON filled.doc_id = pg.doc_id AND filled.p = pg.p
    LEFT JOIN pa ON pa.doc_id = filled.doc_id AND pa.p = filled.p LEFT JOIN pb ON pb.doc_id = filled.doc_id AND pb.p = filled.p GROUP BY 1, 2),
  j AS (SELECT round(count(*) FILTER (WHERE pa.p IS NOT NULL AND pb.p IS NOT NULL) / count(*) FILTER (WHERE pa.p IS NOT NULL OR pb.p IS NOT NULL), 4) AS j
    FROM filled LEFT JOIN pa ON pa.doc_id = filled.doc_id AND pa.p = filled.p LEFT JOIN pb ON pb.doc_id = filled.doc_id AND pb.p = filled.p),
  t AS (SELECT ['person', 'email', 'phone'][k % 3 + 1] AS category, count(*) AS labels, count(*) FILTER (WHERE a AND b) AS both_covered, count(*) FILTER (WHERE a AND NOT b) AS only_first,
    count(*) FILTER (WHERE b AND NOT a) AS only_second, count(*) FILTER (WHERE NOT a AND NOT b) AS neither, grouping(k % 3) AS whole FROM lab GROUP BY ROLLUP (k % 3)),
  s AS (SELECT *, (both_covered + neither) / labels AS same, (both_covered + only_first) / labels AS x, (both_covered + only_second) / labels AS y FROM t)
SELECT category, labels, both_covered, only_first, only_second, neither, round(same, 4) AS observed,
  CASE WHEN x * y + (1 - x) * (1 - y) <> 1 THEN round((same - (x * y + (1 - x) * (1 - y))) / (1 - (x * y + (1 - x) * (1 - y))), 4) END AS kappa, CASE WHEN whole = 1 THEN j END AS redacted_jaccard FROM s, j""")
def run_agreement(spark, d):
    """Labels and two runs at places derived from ids, over the texts of documents."""
    docs = table(spark, d, "documents").where(F.length("text") >= 200).select("doc_id", "text", F.length("text").alias("n"))

    def spans(name: str):
        ks, start, size = _RUN[name]
        rows = docs.select("doc_id", "n", F.explode(F.expr(f"sequence({ks[6:-1].split(',')[0]}, {int(ks[6:-1].split(',')[1]) - 1})")).alias("k")).withColumn("start", F.expr(start))
        return rows.select("doc_id", "start", (c("start") + F.expr(size)).alias("end"), F.element_at(F.array(*map(F.lit, ("person", "email", "phone"))), c("k") % 3 + 1).alias("category"))

    return compare.run_agreement(docs.select("doc_id", "text"), spans("g"), spans("a"), spans("b"))


_RANK = "min(value) FILTER (WHERE i = least(floor(n * {0}), n - 1)) AS p{1}"


@query(f"""SELECT event_type, {", ".join(_RANK.format(s, round(s * 100)) for s in (0.5, 0.95, 0.99))} FROM
  (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) GROUP BY 1""")
def event_percentiles(spark, d):
    """Exact percentiles by narrowing histograms, from 500 rows of a key on."""
    return ranks.percentiles(table(spark, d, "events"), ["event_type"], "value", [0.5, 0.95, 0.99], few=500)


@query("""WITH q AS (SELECT coalesce(lang, 'none') AS lang, count(*) AS n, count(*) * least(100, sum(count(*)) OVER ()) / sum(count(*)) OVER () AS e FROM documents WHERE doc_id IS NOT NULL GROUP BY 1),
  r AS (SELECT lang, floor(e) + CASE WHEN row_number() OVER (ORDER BY e - floor(e) DESC, lang) <= least(100, sum(n) OVER ()) - sum(floor(e)) OVER () THEN 1 ELSE 0 END AS quota FROM q),
  h AS (SELECT doc_id, coalesce(lang, 'none') AS lang, row_number() OVER (PARTITION BY coalesce(lang, 'none') ORDER BY CAST('0x' || substr(md5('7:' || doc_id), 1, 15) AS BIGINT), doc_id) AS i FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, h.lang FROM h JOIN r ON h.lang = r.lang WHERE i <= quota""")
def sampled_documents(spark, d):
    """A hundred documents, each language by its share."""
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("none")).alias("lang"))
    return ranks.stratified_sample(docs, "lang", "doc_id", 100, seed=7, few=100)


_NODES = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 64 = 0 THEN NULL WHEN o_orderkey % 500 = 7 THEN o_orderkey + 1 WHEN o_orderkey % 311 = 5 THEN -o_orderkey ELSE o_orderkey - 1 - o_orderkey % 3 END AS parent,
  CASE o_orderkey % 4 WHEN 0 THEN concat('msg-', o_orderkey % 100) WHEN 1 THEN concat(o_orderkey % 7, '.', o_orderkey % 11) WHEN 2 THEN concat('.file ', o_orderkey) END AS part,
  CASE WHEN o_orderkey % 5 = 0 THEN 'mbox' ELSE 'eml' END AS kind, concat('upload-', o_orderkey % 10, '.pdf') AS name, o_orderkey AS seq FROM orders"""


@query(f"""WITH RECURSIVE n AS ({_NODES}), m AS (SELECT n.*, p.id AS up, p.kind AS up_kind, CASE WHEN regexp_matches(n.part, '^msg-[0-9]+$') THEN CAST(substr(n.part, 5) AS BIGINT) END AS idx,
    coalesce(n.part, CAST(n.id AS VARCHAR)) AS own FROM n LEFT JOIN n p ON n.parent = p.id AND n.parent <> n.id),
  w AS (SELECT up AS box, greatest(4, length(CAST(coalesce(max(idx), 0) + 1 AS VARCHAR))) AS width FROM m WHERE up IS NOT NULL GROUP BY 1),
  s AS (SELECT m.*, w.box IS NULL AS leaf, coalesce(nullif(regexp_replace(regexp_replace(own, '[^A-Za-z0-9._-]', '_', 'g'), '^\\.+', ''), ''), 'part') AS safe FROM m LEFT JOIN w ON w.box = m.id),
  f AS (SELECT s.*, CASE WHEN up_kind = 'mbox' THEN CASE WHEN idx IS NULL THEN safe ELSE lpad(CAST(idx + 1 AS VARCHAR), CAST(width AS INTEGER), '0') END || '/' WHEN leaf THEN 'attachments/' ELSE 'attachments/' || safe || '/' END AS folder FROM s LEFT JOIN w ON w.box = s.up),
  r AS (SELECT id, CASE WHEN k > 1 THEN base || '-' || k ELSE base END AS stem FROM (SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY seq, id) AS k FROM (SELECT id, seq, regexp_replace(name, '\\.[^.]+$', '') AS base FROM f WHERE up IS NULL))),
  t AS (SELECT f.id, f.id AS root, 0 AS level, '' AS path, CASE WHEN leaf THEN '' ELSE r.stem || '-redacted/' END AS dir, r.stem || '-redacted/' AS inner_, r.stem AS stem FROM f JOIN r ON f.id = r.id
    UNION ALL SELECT f.id, t.root, t.level + 1, CASE WHEN t.level = 0 THEN f.own ELSE t.path || '/' || f.own END, t.inner_ || f.folder, t.inner_ || f.folder, CASE WHEN f.up_kind = 'mbox' THEN 'message' ELSE f.safe END FROM t JOIN f ON f.up = t.id)
SELECT f.id, CASE WHEN root IS NULL THEN 'cycle' WHEN up IS NOT NULL THEN 'part' WHEN parent IS NULL THEN 'root' ELSE 'orphan' END AS outcome, root, level, path, dir, stem FROM f LEFT JOIN t ON f.id = t.id""")
def order_provenance(spark, d):
    """Roots, paths and folders of a forest over the orders, with chains, orphans and cycles."""
    table(spark, d, "orders").createOrReplaceTempView("_orders_of_provenance")
    nodes = spark.sql(_NODES.replace("FROM orders", "FROM _orders_of_provenance"))
    return provenance.provenance(nodes, place=False)


@query("SELECT page_id, CAST(0 AS BIGINT) AS left_over FROM pages")
def redacted_sources(spark, d):
    """Pages whose words of eight letters and more are cut out of the HTML, read again: how many of them are left."""
    docs = table(spark, d, "pages").select(c("page_id").alias("doc_id"), "html")
    read = atoms.read_html(docs)
    text = read.select("doc_id", c("_h.text").alias("text"))
    words = text.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([a-z]{8,})"))).alias("value")).distinct()
    again = atoms.read_html(atoms.redact_html(docs, words, label="[X]", read=read), "redacted").select("doc_id", c("_h.text").alias("text"))
    left = matching.value_places(again, words).groupBy("doc_id").agg(F.count("*").alias("n"))
    return docs.select("doc_id").join(left, "doc_id", "left").select(c("doc_id").alias("page_id"), F.coalesce("n", F.lit(0)).alias("left_over"))


_HITS = "SELECT '{0}' AS rule_id, doc_id, '{3}' AS category, len(regexp_extract_all(text, '(?i){2}')) AS n FROM documents WHERE lang = '{1}'"
_LIVE = [("r1", "en", "ing", "other"), ("r2", "de", "und", "person"), ("r5", "es", "que", "other")]


@query(f"SELECT rule_id, doc_id, category, CAST(n AS BIGINT) AS n FROM ({' UNION ALL '.join(_HITS.format(*r) for r in _LIVE)}) WHERE n > 0")
def upkept_rules(spark, d):
    """Three epochs of changes to rules of batches (languages), half of the documents arriving in the last one."""
    docs = table(spark, d, "documents").where("lang is not null and doc_id is not null")
    held, pages = docs.select("doc_id", c("lang").alias("batch_id")), docs.select("doc_id", F.lit(1).alias("page"), "text")
    state = upkeep.BatchRules(spark, f"{shared_folder(spark)}/batch-rules-{uuid.uuid4().hex}")

    def changes(*rows):
        own = [(seq, op, rule, f.get("batch_id"), *(f.get(k) for k in upkeep.FIELDS)) for seq, op, rule, f in rows]
        return spark.createDataFrame(own, upkeep.CHANGES)

    early, late = held.where("doc_id % 2 = 0"), held.where("doc_id % 2 = 1")
    state.apply(1, changes((1, "create", "r1", {"batch_id": "en", "pattern": "the"}), (2, "create", "r2", {"batch_id": "de", "pattern": "und"}), (3, "create", "r4", {"batch_id": "en", "pattern": "of"})), early, pages)
    state.apply(2, changes((4, "update", "r1", {"pattern": "ing"}), (5, "update", "r2", {"enabled": False}), (6, "remove", "r4", {}), (7, "create", "r5", {"batch_id": "es", "pattern": "que"})), early, pages)
    state.apply(3, changes((8, "update", "r2", {"enabled": True, "category": "person"})), held, pages, late)
    return state.rows().groupBy("rule_id", "doc_id", "category").agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'F' AND o_orderdate IS NOT NULL), n AS (SELECT CAST(ceil(count(*) / 6.0) AS BIGINT) AS size FROM e)
SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // size AS page FROM e, n""")
def paged_orders(spark, d):
    """Six pages by keyset, each behind the last row of the one before."""
    rows = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate").where("o_orderdate is not null")
    size, keys, out, cursor = -(-rows.count() // 6), ["o_orderdate", "o_orderkey"], None, None
    for page in range(6):
        own = (rows if cursor is None else rows.where(paging.after(keys, cursor))).orderBy(*keys).limit(size)
        ends = own.agg(F.max(F.struct(*keys)).alias("m")).first().m
        now = own.select("o_orderkey", F.lit(page).cast("long").alias("page"))
        out = now if out is None else out.unionByName(now)
        if ends is None:
            break
        cursor = list(ends)
    return out


_REASON = "CASE WHEN o_orderkey % 13 < 9 THEN [" + ", ".join(f"'{r}'" for r in reports.SKIP_REASONS) + "][CAST(o_orderkey % 13 + 1 AS INT)] END"


@query(f"""WITH d AS (SELECT o_custkey % 20 AS batch_id, o_orderkey AS doc_id, {_REASON} AS reason FROM orders), i AS (SELECT * FROM d WHERE reason IS NULL),
  o AS (SELECT i.batch_id, i.doc_id, l_returnflag AS category, l_linestatus AS style, CASE l_linenumber % 4 WHEN 0 THEN 'mask' WHEN 1 THEN 'tokenize' WHEN 2 THEN 'pseudonymize' ELSE 'remove' END AS method, CAST(l_quantity AS BIGINT) AS n FROM i JOIN lineitem ON l_orderkey = i.doc_id),
  t AS (SELECT doc_id, sum(n) AS n FROM o GROUP BY 1)
SELECT batch_id, 'included' AS section, NULL AS key, count(DISTINCT i.doc_id) AS documents, CAST(coalesce(sum(n), 0) AS BIGINT) AS "values" FROM i LEFT JOIN t ON i.doc_id = t.doc_id GROUP BY 1
UNION ALL SELECT batch_id, 'skipped', reason, count(DISTINCT doc_id), 0 FROM d WHERE reason IS NOT NULL GROUP BY 1, 3
UNION ALL SELECT batch_id, 'category', category, count(DISTINCT doc_id), CAST(sum(n) AS BIGINT) FROM o GROUP BY 1, 3
UNION ALL SELECT batch_id, 'style', style, count(DISTINCT doc_id), CAST(sum(n) AS BIGINT) FROM o GROUP BY 1, 3
UNION ALL SELECT batch_id, 'not-removed', NULL, count(DISTINCT doc_id), CAST(sum(doc_id % 3) AS BIGINT) FROM i WHERE doc_id % 2 = 0 GROUP BY 1
UNION ALL SELECT batch_id, 'reversible', NULL, count(DISTINCT doc_id), CAST(sum(n) AS BIGINT) FROM o WHERE method = 'tokenize' AND n > 0 GROUP BY 1
UNION ALL SELECT batch_id, 'pseudonymised', NULL, count(DISTINCT doc_id), CAST(sum(n) AS BIGINT) FROM o WHERE method = 'pseudonymize' AND n > 0 GROUP BY 1""")
def batch_outcomes(spark, d):
    """The export report of batches of orders, lines as what was removed, with all nine reasons."""
    reason = F.when(c("o_orderkey") % 13 < 9, F.element_at(F.array(*map(F.lit, reports.SKIP_REASONS)), (c("o_orderkey") % 13 + 1).cast("int")))
    docs = table(spark, d, "orders").select((c("o_custkey") % 20).alias("batch_id"), c("o_orderkey").alias("doc_id"), F.when(c("o_orderkey") % 13 < 9, reason).alias("reason"))
    method = F.element_at(F.array(*map(F.lit, ("mask", "tokenize", "pseudonymize", "remove"))), (c("l_linenumber") % 4 + 1).cast("int"))
    removed = table(spark, d, "lineitem").select(c("l_orderkey").alias("doc_id"), c("l_returnflag").alias("category"), c("l_linestatus").alias("style"), method.alias("method"), c("l_quantity").cast("long").alias("count"))
    left = docs.where("doc_id % 2 = 0").select("doc_id", (c("doc_id") % 3).alias("count"))
    return reports.batch_outcomes(docs, removed, left)


@query("""WITH c AS (SELECT c_nationkey AS doc_id, c_custkey AS row, 1 AS col, c_name AS value FROM customer UNION ALL SELECT c_nationkey, c_custkey, 2, c_mktsegment FROM customer)
SELECT 'r1' AS rule_id, doc_id, row, col, 'buil' AS text, 'other' AS category FROM c WHERE contains(lower(value), 'buil')
UNION ALL SELECT 'r2', doc_id, row, col, regexp_extract(value, '0[0-9]7'), 'customer-id' FROM c WHERE regexp_matches(value, '0[0-9]7')
UNION ALL SELECT 'r3', doc_id, row, col, 'MACHINERY', 'other' FROM c WHERE value = 'MACHINERY'""")
def rule_cells(spark, d):
    """Rules over cells, each cell once a rule: a literal, an expression, and a whole word in its own case."""
    t = table(spark, d, "customer")
    cells = reduce(DataFrame.unionByName, (t.select(c("c_nationkey").alias("doc_id"), c("c_custkey").alias("row"), F.lit(i + 1).alias("col"), c(n).alias("value")) for i, n in enumerate(("c_name", "c_mktsegment"))))
    own = [("r1", "literal", "buil", False, False, "other"), ("r2", "regex", "0[0-9]7", True, False, "customer-id"), ("r3", "literal", "MACHINERY", True, True, "other")]
    return rules.find_cell_matches(spark.createDataFrame(own, "rule_id string, kind string, pattern string, match_case boolean, whole_word boolean, category string"), cells).withColumn("doc_id", c("doc_id").cast("int"))


@query("""WITH v AS (SELECT DISTINCT c_nationkey AS doc_id, lower(c_mktsegment) AS v FROM customer WHERE c_custkey % 10 = 0), c AS (SELECT c_nationkey AS doc_id, c_custkey AS row, 1 AS col, c_name AS value FROM customer UNION ALL SELECT c_nationkey, c_custkey, 2, 'of ' || lower(c_mktsegment) || 's' FROM customer)
SELECT c.doc_id, row, col, v AS text FROM c JOIN v ON c.doc_id = v.doc_id AND contains(lower(value), v)""")
def value_cells(spark, d):
    """Cells that hold a value found elsewhere in their document, within longer words too."""
    t = table(spark, d, "customer")
    found = t.where("c_custkey % 10 = 0").select(c("c_nationkey").alias("doc_id"), c("c_mktsegment").alias("text"), F.lit("other").alias("category"), F.lit("").alias("reason"), F.lit(True).alias("everywhere"), c("c_custkey").alias("seq"))
    values = ((1, c("c_name")), (2, F.concat(F.lit("of "), F.lower("c_mktsegment"), F.lit("s"))))
    cells = reduce(DataFrame.unionByName, (t.select(c("c_nationkey").alias("doc_id"), c("c_custkey").alias("row"), F.lit(i).alias("col"), v.alias("value")) for i, v in values))
    return spans.expand_cells(found, cells).select("doc_id", "row", "col", F.lower("text").alias("text"))


@query("""WITH r AS (SELECT l_orderkey % 500 AS doc_id, l_orderkey * 10 + l_linenumber AS seq, l_returnflag AS category, CASE WHEN l_linenumber < 6 THEN ' P  ' || l_partkey % 40 END AS text, ['suggested', 'accepted', 'rejected'][l_suppkey % 3 + 1] AS status, l_linenumber AS page FROM lineitem)
SELECT doc_id, category || '|' || CASE WHEN text IS NULL THEN lower(category) ELSE lower(regexp_replace(trim(text), ' +', ' ', 'g')) END AS key, count(*) AS count, count(*) FILTER (WHERE status = 'suggested') AS suggested, count(*) FILTER (WHERE status = 'accepted') AS accepted,
  count(*) FILTER (WHERE status = 'rejected') AS rejected, array_to_string(list_sort(list_distinct(list(page))), ',') AS pages, arg_min(coalesce(text, category), seq) AS text FROM r GROUP BY 1, 2""")
def suggestion_groups(spark, d):
    """Lines as redactions of five hundred documents, grouped by value and category."""
    status = F.element_at(F.array(*map(F.lit, records.STATUSES)), (c("l_suppkey") % 3 + 1).cast("int"))
    text = F.when(c("l_linenumber") < 6, F.concat(F.lit(" P  "), (c("l_partkey") % 40).cast("string")))
    rows = table(spark, d, "lineitem").select((c("l_orderkey") % 500).alias("doc_id"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("seq"), c("l_returnflag").alias("category"), text.alias("text"), status.alias("status"), F.lit("ai").alias("source"), F.lit(0.5).alias("confidence"), F.lit("").alias("reason"), c("l_linenumber").alias("page"))
    out = records.suggestions(rows, None)
    return out.select("doc_id", "key", "count", *records.STATUSES, F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), "text")


@query("""WITH w AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linenumber > 2 GROUP BY 1), o AS (SELECT o_custkey, count(*) AS documents, CAST(coalesce(sum(n), 0) AS BIGINT) AS redactions FROM orders LEFT JOIN w ON o_orderkey = l_orderkey GROUP BY 1)
SELECT c_custkey AS rule_id, coalesce(documents, 0) AS documents, coalesce(redactions, 0) AS redactions FROM customer LEFT JOIN o ON c_custkey = o_custkey""")
def rule_overview(spark, d):
    """Customers as rules, their orders as copies in documents, some lines as what the copies wrote."""
    copies = table(spark, d, "orders").select(c("o_orderkey").alias("copy_id"), c("o_custkey").alias("rule_id"))
    wrote = table(spark, d, "lineitem").where("l_linenumber > 2").select(c("l_orderkey").alias("copy_id"))
    return records.batch_overview(table(spark, d, "customer").select(c("c_custkey").alias("rule_id")), copies, wrote)


@query("""WITH n AS (SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS i FROM orders) WHERE i = 1)
SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM n)
UNION ALL SELECT o_custkey, 'order ' || o_orderkey, o_totalprice FROM n WHERE o_orderkey % 4 <> 0""")
def changed_rows(spark, d):
    """Customers after a change by each of their orders, every fourth a deletion; the last one counts."""
    rows = table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    op = F.when(c("o_orderkey") % 4 == 0, "delete").otherwise("upsert")
    changes = table(spark, d, "orders").select(c("o_custkey").alias("c_custkey"), F.concat(F.lit("order "), c("o_orderkey").cast("string")).alias("c_name"), c("o_totalprice").alias("c_acctbal"), op.alias("op"), c("o_orderkey").alias("seq"))
    return records.changed(rows, changes, "c_custkey")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN CASE WHEN event_type = 'click' THEN 'face' ELSE 'region' END WHEN event_id % 3 = 0 AND user_id % 4 <> 0 AND event_id % 7 <> 0 THEN 'cell' ELSE 'text' END AS type FROM events""")
def detection_types(spark, d):
    """Events as detections, with boxes, whole and partial addresses of cells."""
    box = F.when(c("event_id") % 5 == 0, F.struct(F.lit(1.0).alias("x")))
    kind = records.detection_type(F.when(c("event_type") == "click", "face").otherwise("other"), box, F.when(c("event_id") % 3 == 0, "Data"), c("user_id") % 4, F.when(c("event_id") % 7 != 0, c("event_id")))
    return table(spark, d, "events").select("event_id", kind.alias("type"))


@query("""WITH t AS (SELECT o_orderkey AS k, o_orderkey % 7 AS form FROM orders)
SELECT k AS doc_id, CASE WHEN form IN (1, 5, 6) THEN 'see Ann ' || k || ' and Ann ' || k || CASE form WHEN 1 THEN '' WHEN 5 THEN ' with Bob ' || k ELSE ' with ENC[AAAA]' END || '.'
  WHEN form = 4 THEN 'see PERSON_001 and person_001.' WHEN form = 2 THEN 'see nobody.' ELSE 'see PERSON_001 and PERSON_001' || CASE form WHEN 3 THEN ' with ENC[AAAA]' ELSE '' END || '.' END AS restored_text,
  CASE form WHEN 0 THEN 'unsupported-format' WHEN 3 THEN 'no-key' WHEN 2 THEN 'nothing-to-restore' WHEN 4 THEN 'nothing-to-restore' ELSE 'ok' END AS outcome,
  CAST(CASE form WHEN 1 THEN 1 WHEN 5 THEN 2 WHEN 6 THEN 1 ELSE 0 END AS BIGINT) AS restored, CAST(CASE WHEN form IN (3, 6) THEN 1 ELSE 0 END AS BIGINT) AS unresolved FROM t""")
def restored_documents(spark, d):
    """Exports of orders: pictures, without a key, with a wrong ciphertext, with a vault of something else, or whole."""
    k, form = c("o_orderkey"), c("o_orderkey") % 7
    key = F.substring(F.md5(k.cast("string")), 1, 16).cast("binary")
    cipher = F.aes_encrypt(F.concat(F.lit("Bob "), k.cast("string")), key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("000000000000").cast("binary"))
    inline = F.concat(F.lit(" with ENC["), F.regexp_replace(F.translate(F.base64(cipher), "+/", "-_"), "[=\\r\\n]", ""), F.lit("]"))
    text = F.when(form == 2, "see nobody.").when(form == 4, "see PERSON_001 and person_001.").otherwise(F.concat(F.lit("see PERSON_001 and PERSON_001"), F.when(form == 5, inline).when(form.isin(3, 6), " with ENC[AAAA]").otherwise(""), F.lit(".")))
    o = table(spark, d, "orders")
    out = o.select(k.alias("doc_id"), F.when(form == 0, "pdf").otherwise("txt").alias("kind"), text.alias("text"))
    entry = F.struct(F.when(form == 4, "PERSON_009").otherwise("PERSON_001").alias("surrogate"), F.lit("tokenize").alias("method"), F.lit("person").alias("category"), F.concat(F.lit("Ann "), k.cast("string")).alias("value"))
    vaults = o.select(k.alias("doc_id"), F.to_json(F.struct(F.lit(1).alias("version"), F.array(entry).alias("entries"))).alias("vault"))
    return redact.restore_documents(out, vaults, o.where(form.isin(5, 6)).select(k.alias("doc_id"), key.alias("key"))).drop("kind", "text")


@query("""WITH r AS (SELECT l_orderkey AS doc_id, ['accepted', 'accepted', 'rejected', 'suggested'][l_suppkey % 4 + 1] AS status, CASE WHEN l_linenumber = 3 THEN 'other' ELSE ['person', 'email', 'phone'][l_partkey % 3 + 1] END AS category, ['ai', 'user', 'rule'][l_linenumber % 3 + 1] AS source,
    CASE WHEN l_orderkey % 5 <> 0 THEN 'removed' WHEN l_linenumber % 2 = 0 THEN 'blur' ELSE 'solid' END AS style, CASE WHEN l_partkey % 6 = 0 THEN 'tokenize' ELSE 'mask' END AS method FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT doc_id, CASE status WHEN 'accepted' THEN 'removed' WHEN 'rejected' THEN 'rejected' ELSE 'undecided' END AS section, category AS key, count(*) AS count FROM r GROUP BY 1, 2, 3
UNION ALL SELECT doc_id, 'style', style, count(*) FROM r WHERE status = 'accepted' GROUP BY 1, 3 UNION ALL SELECT doc_id, 'method', method, count(*) FROM r WHERE status = 'accepted' GROUP BY 1, 3
UNION ALL SELECT doc_id, 'source', source, count(*) FROM r WHERE status = 'accepted' GROUP BY 1, 3 UNION ALL SELECT doc_id, 'note', 'weaker-style', count(*) FROM r WHERE status = 'accepted' AND style = 'blur' GROUP BY 1
UNION ALL SELECT doc_id, 'note', 'reversible', count(*) FROM r WHERE status = 'accepted' AND method = 'tokenize' GROUP BY 1 UNION ALL SELECT doc_id, 'note', 'still-present', count(*) FROM r WHERE status <> 'accepted' GROUP BY 1
UNION ALL SELECT o_orderkey, 'note', 'narrowed', 1 FROM orders WHERE o_orderkey % 9 = 0""")
def export_sections(spark, d):
    """Lines as redactions of orders: counts by category, style, method and source, what is left, and notes."""
    pick = lambda names, i: F.element_at(F.array(*map(F.lit, names)), (i + 1).cast("int"))
    docs = table(spark, d, "orders").select(c("o_orderkey").alias("doc_id"), F.when(c("o_orderkey") % 5 == 0, "image").otherwise("txt").alias("kind"), (c("o_orderkey") % 9 == 0).alias("narrowed"))
    category = F.when(c("l_linenumber") == 3, "martian").otherwise(pick(("person", "email", "phone"), c("l_partkey") % 3))
    rows = table(spark, d, "lineitem").select(c("l_orderkey").alias("doc_id"), pick(("accepted", "accepted", "rejected", "suggested"), c("l_suppkey") % 4).alias("status"), category.alias("category"), pick(("ai", "user", "rule"), c("l_linenumber") % 3).alias("source"), (c("l_linenumber") % 2 == 0).alias("boxed"), (c("l_partkey") % 6 == 0).alias("kept"))
    return reports.export_counts(rows, docs, F.when(c("kept"), "tokenize").otherwise("mask"), F.lit("blur"))
