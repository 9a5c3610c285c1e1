"""Documents, revisions, feeds, lint, tenancy and policies."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType
from pyspark.sql.window import Window

from tesserine.functions import text as T

STRUCTURAL = ("/wiki/overview.md", "/wiki/log.md")
# Surface, operation -> policies that allow it.
ALLOWED = {
    ("api", "append"): ("system_managed", "agent_editable", "append_only"),
    ("api", "replace"): ("system_managed", "agent_editable"),
    ("api", "archive"): ("system_managed", "agent_editable", "append_only", "locked"),
    ("agent", "append"): ("agent_editable", "append_only"),
    ("agent", "replace"): ("agent_editable",),
    ("agent", "delete"): ("agent_editable", "append_only"),
    ("compiler", "write"): ("system_managed", "agent_editable", "append_only", "locked"),
}


def in_workspace(df: DataFrame, workspace: str, parent: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Rows of one workspace, by their own column or through their document."""
    if parent is None:
        return df.filter(F.col("workspace_id") == workspace)
    return df.join(parent.filter(F.col("workspace_id") == workspace).select(key), key, "left_semi")


def with_prefix(documents: DataFrame, prefix: str, kind: str | None = None) -> DataFrame:
    """Documents below a path; wildcards in the prefix act as such."""
    out = documents.filter(F.col("path").like(f"{prefix}%") & ~F.col("archived"))
    return out.filter(F.col("kind") == kind) if kind else out


def matching(documents: DataFrame, pattern: str) -> DataFrame:
    pattern = pattern if pattern.startswith("/") else f"/{pattern}"
    return documents.filter(~F.col("archived") & F.col("path").rlike(T.glob_regex(pattern)))


def heads(revisions: DataFrame) -> DataFrame:
    """The latest revision of each document."""
    last = F.max(F.struct("created_at", "revision_id", "content_md")).alias("h")
    return revisions.groupBy("document_id").agg(last).select("document_id", "h.*")


def listing(pages: DataFrame, order: str, which: Column) -> DataFrame:
    """The pages or blocks of some documents with their position and length, in order."""
    position = F.row_number().over(Window.partitionBy("doc_id").orderBy(order))
    return pages.filter(which).withColumns({"position": position, "char_count": F.length("text")})


def read_pages(pages: DataFrame, spec: str) -> DataFrame:
    """doc_id, text: the pages that a range such as ``1-2, 4`` names, in order, joined by a blank line."""
    wanted = pages.filter(F.array_contains(T.page_range(F.lit(spec)), F.col("page_no").cast("int")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda x: x["text"])
    return wanted.groupBy("doc_id").agg(F.array_join(ordered, "\n\n").alias("text"))


def with_member(rows: DataFrame, column: str, key: str, value: str | None = None) -> DataFrame:
    """Rows whose JSON column has a key, or has it with this value."""
    found = F.get_json_object(column, f"$.{key}")
    return rows.filter(found.isNotNull() if value is None else found == value)


def vault_search(documents: DataFrame, query: str) -> DataFrame:
    """Documents that hold the query in path, title, kind or status, without regard to case."""
    found = F.lit(False)
    for c in ("path", "title", "kind", "status"):
        found = found | F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(query.strip().lower()))
    return documents.filter(found)


def with_previous(revisions: DataFrame) -> DataFrame:
    """Each revision with the one before it."""
    before = Window.partitionBy("document_id").orderBy("created_at", "revision_id")
    return revisions.withColumns({"previous_id": F.lag("revision_id").over(before), "previous_md": F.lag("content_md").over(before)})


def latest(df: DataFrame, at: str, key: str, limit: int = 100) -> DataFrame:
    """A feed: the newest rows."""
    return df.orderBy(F.desc(at), F.desc(key)).limit(limit)


#: Built from types and not from a string, which would need a session when the module is imported.
DIFF = ArrayType(StructType([StructField("type", StringType()), StructField("text", StringType())]))


@F.pandas_udf(DIFF)
def line_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """context, removed and added lines of two texts; removed before added where lines were replaced."""

    def one(a: str | None, b: str | None) -> list[dict]:
        a, b, out = (a or "").splitlines(), (b or "").splitlines(), []
        for tag, i, j, k, m in difflib.SequenceMatcher(a=a, b=b).get_opcodes():
            if tag == "equal":
                out += [{"type": "context", "text": x} for x in a[i:j]]
            else:
                out += [{"type": "removed", "text": x} for x in a[i:j]] + [{"type": "added", "text": x} for x in b[k:m]]
        return out

    return pd.Series([one(a, b) for a, b in zip(before, after, strict=True)])


def distinct_line_stats(before: Column, after: Column) -> dict[str, Column]:
    """Counts over distinct lines: JVM-side."""
    a, b = (T.lines(F.coalesce(x, F.lit(""))) for x in (before, after))
    return {"added": F.size(F.array_except(b, a)), "removed": F.size(F.array_except(a, b)), "before_lines": F.size(a), "after_lines": F.size(b)}


def lint(documents: DataFrame, scope: str = "/wiki/") -> DataFrame:
    """rule, path: structural pages that are missing, sparse documents, pages without a table or diagram."""
    docs = documents.filter(~F.col("archived") & F.col("path").like(f"{scope.rstrip('/')}%"))
    text = F.coalesce("content_md", F.lit(""))
    needed = documents.sparkSession.createDataFrame([(p,) for p in STRUCTURAL], "path string")
    missing = needed.join(docs.select("path"), "path", "left_anti").select(F.lit("missing_page").alias("rule"), "path")
    sparse = docs.filter(F.length(T.trim(text)) < 40).select(F.lit("sparse").alias("rule"), "path")
    plain = docs.filter(F.col("path").startswith("/wiki/") & ~F.contains(text, F.lit("```mermaid")) & ~F.contains(text, F.lit("|"))).select(F.lit("no_visual").alias("rule"), "path")
    return missing.unionByName(sparse).unionByName(plain)


def counts(documents: DataFrame) -> DataFrame:
    """Documents of each workspace by kind, in one pass."""
    live = ~F.col("archived")
    return documents.groupBy("workspace_id").agg(*[F.count_if(live & (F.col("kind") == k)).alias(f"{k}_documents") for k in ("source", "wiki", "system")], F.count_if("archived").alias("archived_documents"))


def policy_table(spark: SparkSession) -> DataFrame:
    rows = [(s, o, p, p in ok) for (s, o), ok in ALLOWED.items() for p in ("system_managed", "agent_editable", "append_only", "locked")]
    return spark.createDataFrame(rows, "surface string, operation string, policy string, allowed boolean")


def guarded(commands: DataFrame) -> DataFrame:
    """surface, operation, policy, path -> and ``error``, null where the command may run."""
    rules = F.broadcast(policy_table(commands.sparkSession))  # 28 rows
    removing = F.col("operation").isin("archive", "delete")
    error = F.when(removing & F.col("path").isin(*STRUCTURAL), "structural page").when(~F.coalesce("allowed", F.lit(False)), "policy")
    return commands.join(rules, ["surface", "operation", "policy"], "left").withColumn("error", error).drop("allowed")


def normalised_path(path: Column, kind: Column) -> tuple[Column, Column]:
    """The path with its leading slash, and what is wrong with it."""
    p = F.trim(path)
    p = F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))
    error = F.when(F.trim(path) == "", "empty").when(p.endswith("/"), "ends with a slash").when((kind == "wiki") & ~p.endswith(".md"), "not markdown")
    return p, error


def valid_tokens(tokens: DataFrame, as_of: str) -> DataFrame:
    now = F.lit(as_of).cast("timestamp_ntz")
    return tokens.filter((F.col("expires_at").isNull() | (F.col("expires_at") > now)) & F.col("revoked_at").isNull())


def export_pages(documents: DataFrame) -> DataFrame:
    """Path and content of every live wiki and system page."""
    return documents.filter("not archived and kind in ('wiki', 'system')").select("path", "content_md")
