"""Stores as tables: the code index, knowledge records, vectors, logs, backups, pages of others."""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import validation
from ..operators.order import numbered
from . import commits

MODULES = "id string, exports array<string>, imports array<string>, loc int, degree long, symbols array<struct<line:int,name:string,calls:array<string>>>"
ROUTES = "method string, path string, file string, line int, framework string"
SOURCES = "id string, kind string, reference string, revision string, content string, recorded_at string"
EVENTS = "id string, kind string, source_ids array<string>, actor string, session_id string, occurred_at string, recorded_at string, content string"
VERSIONS = "id string, knowledge_id string, version long, previous_version_id string, kind string, state string, content string, zones array<string>, source_ids array<string>, event_ids array<string>, recorded_at string, valid_from string, valid_until string"
RELATIONS = "id string, kind string, from struct<type:string,id:string>, to struct<type:string,id:string>, source_ids array<string>, recorded_at string, valid_from string, valid_until string"
STORE = {"sources": SOURCES, "events": EVENTS, "versions": VERSIONS, "relations": RELATIONS}
# Largest hook input, records of a page, what is uploaded of a module, largest backup.
HOOK_BYTES, PAGE, BACKUP_BYTES = 2 * 1024 * 1024, 30, 64 * 1024 * 1024
UPLOADED = {"modules": 3000, "exports": 10, "symbols": 25, "calls": 15}
#: The first bytes of a table of word vectors, and its header: mark, version, kind of numbers, dimensions, rows.
MAGIC, HEADER = b"KVEC", "<4sBBHI"


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or no rows where there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def save_index(modules: DataFrame, routes: DataFrame, path: str) -> str:
    """Writes the tables of an index, one for each entity; gives its revision."""
    for name, table in (("modules", modules), ("routes", routes)):
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    return revision(*load_index(modules.sparkSession, path))


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_or_empty(spark, f"{path}/modules", MODULES), read_or_empty(spark, f"{path}/routes", ROUTES)


def revision(*tables: DataFrame) -> str:
    """A token of contents: sums of row hashes, which don't depend on the order of rows or files; `unsaved` if there are none."""
    sums = [t.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(F.to_json(F.struct("*"))).cast("decimal(38,0)")), F.lit(0)).alias("h")).first() for t in tables]
    return "-".join(f"{r.n:x}.{int(r.h) % 2**64:x}" for r in sums) if any(r.n for r in sums) else "unsaved"


RECORDS = "seq long, json string"


def load_store(spark: SparkSession, path: str, at: int | None = None) -> dict[str, DataFrame]:
    """Records of a store by kind, typed, at one revision of all of them: the newest, or an older one."""
    at = commits.revision(spark, path) if at is None else at
    return {name: commits.table(spark, path, name, RECORDS, at).select("seq", F.from_json("json", schema).alias("r")).select("seq", "r.*") for name, schema in STORE.items()}


def append_records(spark: SparkSession, path: str, records: dict[str, DataFrame], base: int | None = None) -> dict[str, int]:
    """Adds records that the store doesn't hold, all kinds in one revision; an id that comes again with other contents is an error and nothing is
    written. Numbers go on from the last one. Raises Conflict if the store has gone on from `base`, the newest revision if none is said."""
    base = commits.revision(spark, path) if base is None else base
    new, added = {}, {}
    for name, rows in records.items():
        store = commits.table(spark, path, name, RECORDS, base)
        own = rows.select(F.to_json(F.struct(*[c for c in rows.columns if c != "seq"])).alias("json"), "id")
        known = store.select(F.get_json_object("json", "$.id").alias("id"), F.col("json").alias("old"))
        both = own.join(known, "id", "left")
        conflict = both.filter("old is not null and old <> json").select("id").limit(1).collect()
        if conflict:
            raise ValueError(f"{name}: {conflict[0].id} is stored with other contents")
        last = store.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
        new[name] = numbered(both.filter("old is null").dropDuplicates(["id"]).select("id", "json"), "id", name="seq", start=last + 1).select("seq", "json")
        added[name] = new[name].count()
    if any(added.values()):
        commits.commit(spark, path, base, {n: rows for n, rows in new.items() if added[n]})
    return added


def import_store(spark: SparkSession, document: str, path: str) -> dict[str, int]:
    """A store in one JSON document: checked as a whole first, then added."""
    schema = ", ".join(f"{n} array<struct<{validation.as_fields(s)}>>" for n, s in STORE.items())
    whole = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(document)
    records = {n: whole.select(F.inline(n)) for n in STORE}
    found = validation.problems(records).limit(1).collect()
    if found:
        raise ValueError(f"{found[0].record}: {found[0].problem}: {found[0].id}")
    return append_records(spark, path, records)


def export_store(spark: SparkSession, path: str, to: str) -> None:
    """Each kind of records as JSON lines."""
    for name, rows in load_store(spark, path).items():
        rows.drop("seq").write.mode("errorifexists").json(f"{to}/{name}")


def store_status(spark: SparkSession, path: str) -> dict[str, int]:
    tables = load_store(spark, path)
    return {n: t.count() for n, t in tables.items()} | {"knowledge": tables["versions"].agg(F.countDistinct("knowledge_id")).first()[0]}


def erase_contents(spark: SparkSession, path: str, ids: DataFrame) -> int:
    """The one change in place: the contents of captured events are erased, nothing else of them, and only of known ids. The events so
    changed are the next revision's, and older ones go, as they hold the contents."""
    base = commits.revision(spark, path)
    rows = commits.table(spark, path, "events", RECORDS, base).withColumn("id", F.get_json_object("json", "$.id"))
    unknown = ids.join(rows, "id", "left_anti").limit(1).collect()
    if unknown:
        raise ValueError(f"unknown event {unknown[0].id}")
    erased = F.to_json(F.from_json("json", EVENTS).withField("content", F.lit("")))
    both = rows.join(ids.select("id").distinct().withColumn("hit", F.lit(True)), "id", "left")
    count = both.filter("hit").count()
    commits.forget(spark, path, commits.commit(spark, path, base, {}, {"events": both.select("seq", F.when(F.col("hit"), erased).otherwise(F.col("json")).alias("json"))}))
    return count


def upsert_vectors(spark: SparkSession, path: str, vectors: DataFrame, to: str) -> DataFrame:
    """vectors(knowledge_id, version, model, vec): the newest version of each key stays, a later one replaces an equal one; written to
    a new folder."""
    schema = "knowledge_id string, version long, model string, vec array<float>"
    old = read_or_empty(spark, path, schema).withColumn("late", F.lit(0))
    rows = old.unionByName(vectors.select(*[c.split()[0] for c in schema.split(", ")]).withColumn("late", F.lit(1)))
    best = rows.groupBy("knowledge_id").agg(F.max_by(F.struct("version", "model", "vec"), F.struct("version", "late")).alias("v"))
    best.select("knowledge_id", "v.*").write.mode("errorifexists").parquet(to)
    return spark.read.schema(schema).parquet(to)


def append_injection(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """rows(at, session, text), a part for each day, so that old days can be deleted."""
    rows.withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").parquet(path)


def last_injections(spark: SparkSession, path: str, characters: int = 8000) -> list[str]:
    """The newest texts that fit into so many characters, oldest first."""
    newest = spark.read.parquet(path).orderBy(F.desc("at"), F.desc("session")).limit(1000).select("text").collect()
    out, room = [], characters
    for r in newest:
        room -= len(r.text)
        if room < 0:
            break
        out.append(r.text)
    return out[::-1]


def vector_table(rows: list[tuple[str, list[int]]], dimensions: int) -> bytes:
    """Word vectors in the binary form: header, then a byte for each number; words go to a list of their own."""
    return struct.pack(HEADER, MAGIC, 1, 1, dimensions, len(rows)) + b"".join(struct.pack(f"{dimensions}b", *v) for _, v in rows)


def _vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for data in frame["content"]:
            mark, _, _, dimensions, count = struct.unpack_from(HEADER, data)
            if mark != MAGIC:
                raise ValueError("not a table of word vectors")
            at = struct.calcsize(HEADER)
            for begin in range(0, count, 4096):
                last = min(count, begin + 4096)
                yield pd.DataFrame({"row": range(begin, last), "vec": [list(struct.unpack_from(f"{dimensions}b", data, at + i * dimensions)) for i in range(begin, last)]})


def read_vector_table(spark: SparkSession, table: str, vocabulary: str) -> DataFrame:
    """word, row, vec: line i of the vocabulary names row i; of words that fold to one the first counts."""
    from ..functions import text

    vectors = spark.read.format("binaryFile").load(table).select("content").mapInPandas(_vectors, "row int, vec array<tinyint>")
    whole = spark.read.text(vocabulary, wholetext=True).select(F.posexplode(F.split(F.rtrim("value", F.lit("\n")), "\n", -1)).alias("row", "word"))
    first = whole.select("row", text.fold(F.lower("word")).alias("word")).groupBy("word").agg(F.min("row").alias("row"))
    return first.join(vectors, "row").select("word", "row", "vec")


def _files(spark: SparkSession, root: str) -> DataFrame:
    """path under the root, sha256, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace("path", "^.*?" + r"\Q" + root.rstrip("/") + r"\E" + "/", "")
    return files.select(rel.alias("path"), "length", F.sha2("content", 256).alias("sha256"), "content")


def backup(spark: SparkSession, root: str, to: str, scope: str = "") -> int:
    """path, sha256, content, scope of all files under a root; written once, never over another one, and outside the root. Files are read, copied and read again: a backup
    during which any of them came, went or changed is deleted and fails."""
    if f"{to.rstrip('/')}/".startswith(f"{root.rstrip('/')}/"):
        raise ValueError("a backup lies outside of what it holds")
    size = _files(spark, root).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    if size > BACKUP_BYTES:
        raise ValueError(f"{size} bytes are more than a backup holds")
    _files(spark, root).select("path", "sha256", "content", F.lit(scope).alias("scope")).write.mode("errorifexists").parquet(to)
    copied = spark.read.parquet(to)
    now = _files(spark, root).select("path", "sha256")
    wrong = copied.filter(F.sha2("content", 256) != F.col("sha256")).select("path", "sha256")
    changed = now.exceptAll(copied.select("path", "sha256")).unionAll(copied.select("path", "sha256").exceptAll(now)).unionAll(wrong).select("path").limit(1).collect()
    if changed:
        fs, at = commits._place(spark, to)
        fs.delete(at, True)
        raise ValueError(f"{changed[0].path} changed during the backup")
    return copied.count()


def restored(spark: SparkSession, path: str) -> DataFrame:
    """path, content of a backup whose hashes all agree."""
    rows = spark.read.parquet(path)
    broken = rows.filter(F.sha2("content", 256) != F.col("sha256")).select("path").limit(1).collect()
    if broken:
        raise ValueError(f"{broken[0].path} does not agree with its hash")
    return rows.select("path", "content")


def restore(spark: SparkSession, path: str, to: str, scope: str = "", relocate: bool = False) -> int:
    """Writes the files of a backup, which is bounded, to a folder that is not there yet: beside it first, then all of them under its name."""
    rows = restored(spark, path)
    other = spark.read.parquet(path).filter(F.col("scope") != scope).select("scope").limit(1).collect()
    if other and not relocate:
        raise ValueError(f"the backup is of {other[0].scope}")
    fs, target = commits._place(spark, to)
    if fs.exists(target):
        raise ValueError(f"{to} is there already")
    aside, count = f"{to.rstrip('/')}.restore-{uuid.uuid4().hex[:12]}", 0
    for r in rows.toLocalIterator():
        if r.path.startswith("/") or ".." in r.path.split("/"):
            raise ValueError(f"{r.path} leads out of the folder")
        out = fs.create(commits._place(spark, f"{aside}/{r.path}")[1], False)
        out.write(bytearray(r.content))
        out.close()
        count += 1
    if fs.exists(target) or not fs.rename(commits._place(spark, aside)[1], target):
        raise ValueError(f"{to} came into being meanwhile")
    return count


def new_page_records(pages: DataFrame, known: DataFrame, repository: str) -> DataFrame:
    """pages(record string JSON, url) -> id, url, content: records of one repository that are not known; an id is the hash of the
    record with its keys in order. If a column `page` tells pages apart, one of more than PAGE records is refused."""
    from ..functions import paths, text

    if "page" in pages.columns:
        long = pages.groupBy("page").count().filter(F.col("count") > PAGE).limit(1).collect()
        if long:
            raise ValueError(f"page {long[0].page} has {long[0]['count']} records, more than {PAGE}")

    canonical = text.canonical_json(F.col("record"))
    own = pages.filter(F.startswith(paths.remote_name(F.col("url")), F.lit(repository + "/"))).select(F.sha2(canonical.cast("binary"), 256).alias("id"), "url", canonical.alias("content"))
    return own.dropDuplicates(["id"]).join(known.select("id"), "id", "left_anti")


def uploaded(modules: DataFrame) -> DataFrame:
    """What of a graph goes to a service: bounded lists of bounded modules, by id."""
    calls = F.transform(F.slice("symbols", 1, UPLOADED["symbols"]), lambda s: F.struct(s["name"].alias("name"), F.slice(s["calls"], 1, UPLOADED["calls"]).alias("calls")))
    return modules.orderBy("id").limit(UPLOADED["modules"]).select("id", F.slice("exports", 1, UPLOADED["exports"]).alias("exports"), "imports", calls.alias("symbols"))


def pulled(pages: DataFrame, cursor: int, size: int = 500) -> tuple[list[dict], int, bool]:
    """pages(seq, type, record JSON): the page after a cursor, the next cursor, and whether there is more."""
    rows = pages.filter(F.col("seq") > cursor).orderBy("seq").limit(size + 1).collect()
    page = rows[:size]
    return [{"seq": r.seq, "type": r.type, "record": json.loads(r.record)} for r in page], page[-1].seq if page else cursor, len(rows) > size


def hook_inputs(lines: DataFrame, schema: str) -> DataFrame:
    """lines(value) -> documents of at most HOOK_BYTES bytes that parse; works on a stream as well."""
    small = lines.filter(F.octet_length("value") <= HOOK_BYTES)
    return small.select(F.from_json("value", schema).alias("r")).filter("r is not null").select("r.*")


def sessions(captures: DataFrame) -> DataFrame:
    """session, events, last of captured events."""
    return captures.groupBy("session_id").agg(F.count("*").alias("events"), F.max("recorded_at").alias("last"))


def session_events(captures: DataFrame, session: str) -> DataFrame:
    """Events of one session in order; of those whose name doesn't tell their id none counts."""
    named = F.regexp_extract("file", r"([^/]+)\.json$", 1) == F.col("event_id")
    return captures.filter((F.col("session_id") == session) & named).orderBy("recorded_at", "event_id")
