"""Where documents that came out of others stand: roots, paths, order and folders, by pointer doubling.

Every row points to an ancestor and holds what lies between. A round joins rows to what they point to, so that pointers
reach twice as far: a forest of depth 1,000 takes ten rounds, each a table in the shared folder. A row that points to a
root is done; when a round finishes none, what is left runs in a cycle.

Only rows that others came out of are doubled. Levels and cycles come first, by ids alone; then each row gets the way to
the nearest of the stations, which are every eighth level, and stations alone get the whole way to their root. Rows of a cycle
hold no way, which would double every round. Whole ways are put together in the result, and are not written in any table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from inkspan.tables import discard, exists, kept, kept_at

#: Levels from one station to the next.
STATION = 8


def message_index(part: Column) -> Column:
    """``msg-12`` to 12, else null."""
    return F.when(part.rlike(r"\Amsg-[0-9]+\z"), F.regexp_extract(part, r"([0-9]+)\z", 1).cast("decimal(38,0)").cast("long"))


def part_order(part: Column) -> Column:
    """What parts of one document are ordered by: messages by number, dotted numbers by their numbers, others by text."""
    text = F.coalesce(part, F.lit(""))
    dotted = F.when(text == "", F.array(F.lit(0).cast("long"))).when(text.rlike(r"\A[0-9]+(\.[0-9]+)*\z"), F.transform(F.split(text, r"\."), lambda s: s.cast("decimal(38,0)").cast("long")))
    kind = F.when(message_index(part).isNotNull(), 0).when(dotted.isNotNull(), 1).otherwise(2)
    numbers = F.coalesce(F.when(message_index(part).isNotNull(), F.array(message_index(part))), dotted, F.array().cast("array<bigint>"))
    return F.struct(kind.alias("kind"), numbers.alias("numbers"), text.alias("text"))


def safe_part(part: Column) -> Column:
    """A name that is a folder: other characters become ``_``, leading dots go."""
    safe = F.regexp_replace(F.regexp_replace(part, "[^A-Za-z0-9._-]", "_"), r"\A\.+", "")
    return F.when(safe == "", "part").otherwise(safe)


def _doubled(rows: DataFrame) -> tuple[DataFrame, int]:
    """rows (id, up, root, and what lies between: arrays or texts, which are put together, and numbers, which are added)
    until all that can have reached a root, and the rounds taken. A round's table has only the rows that moved; those that
    go on are deleted when they have."""
    kinds = {f.name: f.dataType for f in rows.schema.fields if f.name not in ("id", "up", "root")}
    join = {c: (F.concat if isinstance(k, (T.StringType, T.ArrayType)) else lambda x, y: F.col(x) + F.col(y)) for c, k in kinds.items()}
    spark, done, rounds = rows.sparkSession, None, 0

    def round_of(df: DataFrame, done: DataFrame | None) -> tuple[DataFrame, DataFrame, str]:
        path = kept_at(df.withColumn("_done", F.col("up").isNull()), "pointers", "_done")
        read = lambda flag: spark.read.schema(df.schema).parquet(at) if exists(spark, at := f"{path}/_done={flag}") else spark.createDataFrame([], df.schema)
        own = read("true")
        return own if done is None else done.unionByName(own), read("false"), f"{path}/_done=false"

    done, active, path = round_of(rows, None)
    left = active.count()
    while left:
        above = done.unionByName(active).select(F.col("id").alias("_id"), F.col("up").alias("_up"), F.col("root").alias("_root"), *(F.col(c).alias(f"_{c}") for c in kinds))
        going = active.join(above, F.col("up") == F.col("_id"))
        moved = going.select("id", F.col("_up").alias("up"), F.col("_root").alias("root"), *(f(f"_{c}", c).alias(c) for c, f in join.items()))
        (done, active, new), last = round_of(moved, done), left
        discard(spark, path)
        path, rounds = new, rounds + 1
        left = active.count()
        if left == last:
            break
    return done.unionByName(active), rounds


def _reached(held: DataFrame) -> DataFrame:
    """id, root and whole way (level, path, folders, and place if there) of the rows that reach a root: held has id, up and
    their own share of each."""
    ways = [c for c in held.columns if c not in ("id", "up")]
    levels = _doubled(held.select("id", "up", F.when(F.col("up").isNull(), F.col("id")).alias("root"), "level"))[0]
    at = levels.where("up is null").select(F.col("id").alias("_i"), (F.col("level") % STATION == 0).alias("_station"), (F.col("level") == 0).alias("_top"))
    at = kept(held.join(at, F.col("id") == F.col("_i")).drop("_i"), "levels")
    none = {f.name: F.lit(0).cast(f.dataType) if f.name == "level" else F.lit("") if isinstance(f.dataType, T.StringType) else F.slice(f.name, 1, 0) for f in at.schema.fields}
    near = _doubled(at.select("id", F.when(~F.col("_station"), F.col("up")).alias("up"), F.when(F.col("_station"), F.col("id")).alias("root"), *(F.when(F.col("_station"), none[c]).otherwise(F.col(c)).alias(c) for c in ways)))[0].drop("up")
    before = near.select(F.col("id").alias("_i"), F.col("root").alias("_from"), *(F.col(c).alias(f"_{c}") for c in ways))
    put = lambda a, b, c: (F.coalesce(F.col(a), none[c]) + F.col(b) if c == "level" else F.concat(F.coalesce(F.col(a), none[c]), F.col(b))).alias(c)
    stations = at.where("_station").join(before, F.col("up") == F.col("_i"), "left").select("id", F.col("_from").alias("up"), F.when(F.col("_top"), F.col("id")).alias("root"), *(put(f"_{c}", c, c) for c in ways))
    whole = _doubled(stations)[0].select(F.col("id").alias("_i"), F.col("root").alias("_root"), *(F.col(c).alias(f"_{c}") for c in ways))
    return near.join(whole, F.col("root") == F.col("_i")).select("id", F.col("_root").alias("root"), *(put(f"_{c}", c, c) for c in ways))


def provenance(nodes: DataFrame, place: bool = True) -> DataFrame:
    """id, outcome, root, level, path, place, dir, stem of documents (id, parent, part, name, kind, seq).

    outcome: root, part, orphan (its parent is unknown or itself: it stands as a root) or cycle (the rest is null). path:
    parts below the root; place, unless it is not asked for: what to sort by, with the root's seq, for parents before
    children and parts in order. dir and stem: where a processed file goes: messages of a mailbox to numbered folders of one
    width (four digits or more), attachments below ``attachments/``; roots of one name get -2, -3 and so on by seq. ids are unique."""
    spark, index = nodes.sparkSession, message_index(F.col("part"))
    width = F.greatest(F.lit(4), F.length((F.coalesce(F.max(index), F.lit(0)) + 1).cast("string"))).alias("_width")
    children = nodes.where("parent is not null and parent != id").groupBy(F.col("parent").alias("_c")).agg(width)
    first = kept_at(nodes.join(children, F.col("id") == F.col("_c"), "left").withColumn("_c", F.col("_c").isNotNull()), "nodes")
    own = spark.read.parquet(first)
    boxes = own.where("_c").select(F.col("id").alias("_p"), F.col("kind").alias("_kind"), F.col("_width").alias("_w"))
    about = kept(own.drop("_width").join(boxes, (F.col("parent") == F.col("_p")) & (F.col("parent") != F.col("id")), "left").withColumnRenamed("_w", "_width"), "nodes")
    discard(spark, first)
    part = F.coalesce("part", F.col("id").cast("string"))
    number = (index + 1).cast("string")
    label = F.when(index.isNull(), safe_part(part)).otherwise(F.when(F.length(number) >= F.col("_width"), number).otherwise(F.lpad(number, F.col("_width"), "0")))
    mail = F.col("_kind").eqNullSafe("mbox")
    folder = F.when(mail, F.concat(label, F.lit("/"))).when(~F.col("_c"), F.lit("attachments/")).otherwise(F.concat(F.lit("attachments/"), safe_part(part), F.lit("/")))
    below = F.col("_p").isNotNull()
    share = {"level": below.cast("long"), "path": F.when(below, F.concat(part, F.lit("/"))).otherwise(""), "folders": F.when(below, folder).otherwise("")}
    if place:
        share["place"] = F.when(below, F.array(part_order(F.col("part")))).otherwise(F.slice(F.array(part_order(F.col("part"))), 1, 0))
    reached = _reached(about.where("_c").select("id", F.col("_p").alias("up"), *(v.alias(k) for k, v in share.items())))
    base = F.regexp_replace("name", r"\.[^.]+\z", "")
    base = F.trim(F.substring(F.regexp_replace(F.regexp_replace(base, r'[\\/:*?"<>|]', "_"), r"\A\.+", ""), 1, 80))
    base = F.when(F.length(base) == 0, "document").otherwise(base)
    n = F.row_number().over(Window.partitionBy("_base").orderBy("seq", "id"))
    roots = about.where(~below).select("id", "parent", base.alias("_base"), "seq", (~F.col("_c")).alias("_lone"), *(v.alias(k) for k, v in share.items() if k == "place"))
    roots = kept(roots.withColumn("stem", F.when(n > 1, F.concat("_base", F.lit("-"), n.cast("string"))).otherwise(F.col("_base"))), "roots")
    stems = roots.where("not _lone").select(F.col("id").alias("_r"), F.col("stem").alias("_stem"))
    ways = reached.join(stems, F.col("root") == F.col("_r")).select(F.col("id").alias("_i"), "root", *(F.col(c).alias(f"_{c}") for c in share), "_stem")
    rows = about.where(below).select("id", "_p", F.when(mail, F.lit("message")).otherwise(safe_part(part)).alias("_own"), *(v.alias(k) for k, v in share.items())).join(ways, F.col("_p") == F.col("_i"), "left")
    some = F.col("root").isNotNull()
    order = ["place"] if place else []
    parts = rows.select(
        "id", F.when(some, "part").otherwise("cycle").alias("outcome"), "root", F.when(some, F.col("_level") + F.col("level")).cast("int").alias("level"),
        F.concat("_path", F.expr("substring(path, 1, length(path) - 1)")).alias("path"), *(F.concat("_place", "place").alias(c) for c in order),
        F.concat("_stem", F.lit("-redacted/"), "_folders", "folders").alias("dir"), F.when(some, F.col("_own")).alias("stem"),
    )
    top = F.when(F.col("_lone"), F.lit("")).otherwise(F.concat("stem", F.lit("-redacted/")))
    alone = roots.select("id", F.when(F.col("parent").isNull(), "root").otherwise("orphan").alias("outcome"), F.col("id").alias("root"), F.lit(0).alias("level"), F.lit("").alias("path"), *order, top.alias("dir"), "stem")
    return parts.unionByName(alone)
