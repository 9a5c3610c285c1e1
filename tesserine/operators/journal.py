"""Edits of documents by command, and tables whose rows become visible together."""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserine.functions import text as T
from tesserine.operators.documents import ALLOWED, STRUCTURAL
from tesserine.sinks import stored


def _path_error(path: Column, kind: Column) -> Column:
    p = F.trim(path)
    return F.when(F.coalesce(p, F.lit("")) == "", "empty path").when(p.endswith("/"), "path ends with a slash").when((kind == "wiki") & ~p.endswith(".md"), "not markdown")


def _step(acc: Column, x: Column) -> Column:
    """State of one path after one command: refused commands change nothing and tell why."""
    op, text, live = x["operation"], acc["text"], acc["live"]
    key = F.concat_ws("|", x["surface"], op, acc["policy"])
    allowed = F.array(*[F.lit(f"{s}|{o}|{p}") for (s, o), ok in ALLOWED.items() for p in ok])
    removing, old, new = op.isin("archive", "delete"), x["old_text"], F.coalesce(x["new_text"], F.lit(""))
    error = (
        F.when(op == "create", F.coalesce(x["path_error"], F.when(live, F.lit("exists"))))
        .when(~live, "not found")
        .when(removing & x["path"].isin(*STRUCTURAL), "structural page")
        .when(~F.array_contains(allowed, key), "policy")
        .when((op == "replace") & F.coalesce((old == "") | (T.occurrences(text, old) != 1), F.lit(True)), "not exactly one match")
    )
    fine = error.isNull()
    after = F.when(fine & (op == "create"), new).when(fine & (op == "append"), T.append_markdown(text, new)).when(fine & (op == "replace"), F.replace(text, old, new)).otherwise(text)
    made = fine & (op == "create")
    entry = F.struct(x["seq"].alias("seq"), x["surface"].alias("surface"), op.alias("operation"), error.alias("error"), F.when(fine, after).alias("content_md"), F.when(made, x["doc_id"]).otherwise(acc["doc_id"]).alias("doc_id"))
    pick = lambda mine, theirs: F.when(made, mine).otherwise(theirs)
    return F.struct(
        ((live | made) & ~(fine & removing)).alias("live"),
        pick(x["doc_id"], acc["doc_id"]).alias("doc_id"), pick(F.coalesce(x["policy"], F.lit("agent_editable")), acc["policy"]).alias("policy"), pick(F.coalesce(x["kind"], F.lit("wiki")), acc["kind"]).alias("kind"), pick(x["title"], acc["title"]).alias("title"),
        after.alias("text"), F.when(fine, x["seq"]).otherwise(acc["last"]).alias("last"), (acc["archived"] | (fine & removing)).alias("archived"),
        F.concat(acc["log"], F.array(entry)).alias("log"),
    )


STATE = "struct<live:boolean,doc_id:bigint,policy:string,kind:string,title:string,text:string,last:bigint,archived:boolean,log:array<struct<seq:bigint,surface:string,operation:string,error:string,content_md:string,doc_id:bigint>>>"


def run_commands(documents: DataFrame, commands: DataFrame, as_of: str, keep: bool = False) -> dict[str, DataFrame]:
    """The rows that a batch of commands makes: documents, revisions, steps and activity.

    documents: doc_id, path, title, kind, policy, archived, content_md (that of the head).
    commands: seq (a number that no other command has), path, surface, operation (create, append, replace,
    archive, delete), title, kind, policy, old_text, new_text.  The commands of one path
    run in order, each on what the one before it has left; a create gives a new document whose id is the
    hash of path and seq.  A batch's edits of one path are one row with the text after each, as
    people and agents make them; the compiler's appends go through ``writing.page_pieces``.

    documents: one row for each document that was made or changed, with ``head`` (its
    last revision) and status.  revisions: revision_id (the seq), doc_id, path, operation, content_md, at.
    steps: a row for each command, succeeded or failed with its error.  activity: what succeeded.
    With ``keep`` the commands are run once and their outcome stored, for several of the tables.
    """
    path = F.trim("path")
    rooted = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))
    named = commands.withColumn("path_error", F.when(F.col("operation") == "create", _path_error(F.col("path"), F.coalesce("kind", F.lit("wiki"))))).withColumn("path", F.coalesce(rooted, F.lit("/")))
    columns = ["seq", "path", "surface", "operation", "title", "kind", "policy", "old_text", "new_text", "path_error"]
    listed = named.withColumn("doc_id", F.xxhash64("path", "seq")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*columns, "doc_id"))).alias("todo"))
    # a path can have had other documents, which are archived: the live one counts
    live = documents.filter(~F.col("archived")).select("path", "doc_id", "title", "kind", "policy", F.coalesce("content_md", F.lit("")).alias("text"))
    both = listed.join(live, "path", "left")
    start = F.struct(F.col("doc_id").isNotNull().alias("live"), "doc_id", "policy", "kind", "title", F.coalesce("text", F.lit("")).alias("text"), F.lit(None).cast("long").alias("last"), F.lit(False).alias("archived"), F.expr("cast(array() as array<struct<seq:bigint,surface:string,operation:string,error:string,content_md:string,doc_id:bigint>>)").alias("log")).cast(STATE)
    done = both.select("path", F.aggregate("todo", start, lambda acc, x: _step(acc, x).cast(STATE)).alias("s"))
    entries = done.select("path", F.explode("s.log").alias("e")).select("path", "e.*")
    entries = (stored(entries, "entries") if keep else entries).withColumn("at", F.lit(as_of).cast("timestamp_ntz"))
    fine = entries.filter("error is null")
    # a document that was archived and made again within the batch is two documents
    last = fine.groupBy("doc_id").agg(F.max_by(F.struct("path", "content_md"), "seq").alias("l"), F.max("seq").alias("head"), F.max(F.col("operation").isin("archive", "delete")).alias("archived"))
    made = named.filter("operation = 'create'").select(F.xxhash64("path", "seq").alias("doc_id"), F.col("title").alias("_title"), F.coalesce("kind", F.lit("wiki")).alias("_kind"), F.coalesce("policy", F.lit("agent_editable")).alias("_policy"))
    was = live.select("doc_id", F.col("title").alias("title0"), F.col("kind").alias("kind0"), F.col("policy").alias("policy0"))
    changed = last.join(was, "doc_id", "left").join(made, "doc_id", "left")
    changed = changed.select("doc_id", "l.path", *[F.coalesce(f"{c}0", f"_{c}").alias(c) for c in ("title", "kind", "policy")], "archived", F.when(F.col("archived"), "archived").otherwise("ready").alias("status"), "head", "l.content_md")
    return {
        "documents": changed,
        "revisions": fine.select(F.col("seq").alias("revision_id"), "doc_id", "path", "operation", "content_md", "at"),
        "steps": entries.select("seq", "path", "surface", F.col("operation").alias("step_key"), F.when(F.col("error").isNull(), "succeeded").otherwise("failed").alias("status"), "error", "at"),
        "activity": fine.select("seq", "doc_id", F.concat(F.lit("document."), F.when(F.col("operation") == "create", "created").when(F.col("operation").isin("archive", "delete"), "archived").otherwise("updated")).alias("event_type"), "at"),
    }


class Journal:
    """Tables in one folder of the shared store, whose commits become visible whole or not at all.

    A commit writes each table as Parquet under a name of its own; Spark's tasks can
    fail and be repeated meanwhile, nobody reads it.  Then one small file with the next number
    names what was written.  Its creation is the commit: a number can be taken once only, and
    the one that comes second takes the next.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder.rstrip("/")
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self._folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _commits(self) -> list[int]:
        at = self._hadoop.Path(f"{self._folder}/_commits")
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def commit(self, tables: dict[str, DataFrame]) -> int:
        """Writes the tables and makes them visible; returns the number of the commit."""
        name = uuid.uuid4().hex
        for table, rows in tables.items():
            rows.write.parquet(f"{self._folder}/{name}/{table}")
        body = json.dumps({"folder": name, "tables": sorted(tables)}).encode()
        while True:
            number = max(self._commits(), default=0) + 1
            try:
                out = self._fs.create(self._hadoop.Path(f"{self._folder}/_commits/{number:012d}"), False)
            except Py4JJavaError as e:
                if "FileAlreadyExists" not in str(e.java_exception):
                    raise
                continue
            out.write(body)
            out.close()
            return number

    def _named(self, number: int) -> dict:
        stream = self._fs.open(self._hadoop.Path(f"{self._folder}/_commits/{number:012d}"))
        text = self._spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text) if text else {"tables": []}

    def read(self, table: str, upto: int | None = None) -> DataFrame:
        """The rows of all commits (up to a number) with ``_commit``."""
        parts = []
        for number in self._commits():
            named = self._named(number)
            if (upto is None or number <= upto) and table in named["tables"]:
                parts.append((number, f"{self._folder}/{named['folder']}/{table}"))
        if not parts:
            raise ValueError(f"no commit has a table {table}")
        rows = self._spark.read.parquet(*[p for _, p in parts])
        name = F.regexp_extract(F.input_file_name(), f"/([0-9a-f]{{32}})/{table}/", 1)
        numbers = self._spark.createDataFrame([(p.split("/")[-2], n) for n, p in parts], "_name string, _commit int")
        return rows.withColumn("_name", name).join(F.broadcast(numbers), "_name").drop("_name")  # a row a commit

    def documents(self, upto: int | None = None) -> DataFrame:
        """Each document as its last commit left it, with ``head``, the pointer to its revision."""
        rows = self.read("documents", upto)
        rest = [c for c in rows.columns if c not in ("doc_id", "_commit")]
        return rows.groupBy("doc_id").agg(F.max_by(F.struct(*rest), "_commit").alias("d")).select("doc_id", "d.*")


def with_heads(documents: DataFrame, revisions: DataFrame) -> DataFrame:
    """Documents with the content of the revision that their ``head`` points at, whatever is newer; null without one."""
    text = revisions.select(F.col("revision_id").alias("head"), F.col("content_md").alias("head_md"))
    return documents.join(text, "head", "left")
