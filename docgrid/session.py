"""The engine's front door: one object over a warehouse folder, with the verbs that callers use."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docgrid.functions import rules
from docgrid.functions.ids import owner_hash
from docgrid.operators import governance, graphs, hierarchy, ledger, retrieval, segments, staging, tables


class Conflict(ValueError):
    """Another writer committed first."""


class Warehouse:
    """Tables as sets of Parquet files, named by numbered versions.

    A version is a small file: the schema, a line for each data file, and an end mark.  It is created only if it isn't
    there, so of two writers one fails and tries again; readers take the last version that is whole.  Appending adds files,
    changing rows rewrites those files alone that have such rows, and ``vacuum`` removes what no version needs.
    """

    TRIES, PATIENCE = 6, 40

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _file(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, path: str) -> list[str]:
        p, fs = self._file(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _version(self, name: str, number: str) -> list[str] | None:
        """Lines of a version; None while it isn't whole."""
        path, fs = self._file(f"{self.root}/{name}/versions/{number}")
        stream = fs.open(path)
        try:
            text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        lines = text.split("\n")
        return lines[:-1] if lines[-1] == "end" else None

    def _last(self, name: str) -> tuple[str | None, list[str]]:
        """The last version and its lines; a version that is being written is waited for, as it may be whole any moment."""
        for _ in range(self.PATIENCE):
            numbers = self._list(f"{self.root}/{name}/versions")
            if not numbers:
                return None, []
            if (lines := self._version(name, numbers[-1])) is not None:
                return numbers[-1], lines
            time.sleep(0.25)
        raise Conflict(f"the last version of {name!r} was never ended; vacuum removes it")

    def snapshot(self, name: str) -> str | None:
        return self._last(name)[0]

    def has(self, name: str) -> bool:
        return self.snapshot(name) is not None

    def _frame(self, name: str, lines: list[str]) -> DataFrame:
        schema = StructType.fromJson(json.loads(lines[0]))
        if len(lines) == 1:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{name}/{f}" for f in lines[1:]])

    def read(self, name: str, version: str | None = None) -> DataFrame:
        """The table, or an earlier version of it; a table that was never written raises ValueError."""
        number, lines = (version, self._version(name, version)) if version else self._last(name)
        if number is None or lines is None:
            raise ValueError(f"there is no table {name!r}")
        return self._frame(name, lines)

    def _save(self, name: str, df: DataFrame) -> list[str]:
        """Write rows as new files and name them."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}/{folder}")
        return [f"{folder}/{f}" for f in self._list(f"{self.root}/{name}/{folder}") if f.endswith(".parquet")]

    def _commit(self, name: str, base: str | None, schema: StructType, files: list[str]) -> str:
        number = f"{int(base or 0) + 1:012d}"
        path, fs = self._file(f"{self.root}/{name}/versions/{number}")
        try:
            out = fs.create(path, False)
        except Py4JJavaError as e:
            if fs.exists(path):
                raise Conflict(f"{name!r} changed meanwhile") from e
            raise
        out.write(bytearray("\n".join([schema.json(), *files, "end"]).encode()))
        out.close()
        return number

    def _changed(self, name: str, change: Callable[[str | None, list[str]], tuple[StructType, list[str]]]) -> str:
        """Commit what ``change`` makes of the last version; if another writer was first, of that writer's."""
        for turn in range(self.TRIES):
            base, lines = self._last(name)
            schema, files = change(base, lines)
            try:
                return self._commit(name, base, schema, files)
            except Conflict:
                if turn == self.TRIES - 1:
                    raise
        raise AssertionError

    def write(self, name: str, df: DataFrame, expected: str | None = None) -> str:
        """Replace a table; with ``expected`` only if that version is still the last (ValueError otherwise)."""
        files = self._save(name, df)
        if expected is not None:
            if self.snapshot(name) != expected:
                raise Conflict(f"{name!r} changed meanwhile")
            return self._commit(name, expected, df.schema, files)
        return self._changed(name, lambda base, lines: (df.schema, files))

    def append(self, name: str, df: DataFrame) -> str:
        """Add rows; the files that are there stay as they are."""
        base, lines = self._last(name)
        rows = df.select(*StructType.fromJson(json.loads(lines[0])).names) if base else df
        files = self._save(name, rows)
        return self._changed(name, lambda base, lines: (StructType.fromJson(json.loads(lines[0])) if base else rows.schema, [*lines[1:], *files]))

    def _rewrite(self, name: str, having: Callable[[DataFrame], DataFrame], change: Callable[[DataFrame], DataFrame]) -> str:
        """Replace the files that have rows which ``having`` keeps by what ``change`` makes of their rows."""

        def once(base: str | None, lines: list[str]) -> tuple[StructType, list[str]]:
            if base is None:
                raise ValueError(f"there is no table {name!r}")
            table = self._frame(name, lines)
            # as many names as the table has files at most
            hit = having(table.withColumn("__file", F.col("_metadata.file_path"))).select("__file").distinct().collect() if len(lines) > 1 else []
            touched = {"/".join(r[0].split("/")[-3:]) for r in hit}
            some = self._frame(name, [lines[0], *[f for f in lines[1:] if f in touched]])
            new = change(some).select(*table.columns)
            return table.schema, [f for f in lines[1:] if f not in touched] + self._save(name, new)

        return self._changed(name, once)

    def upsert(self, name: str, df: DataFrame, keys: list[str], version: str) -> str:
        if not self.has(name):
            return self.write(name, df)
        return self._rewrite(name, lambda t: t.join(df.select(*keys).distinct(), keys, "left_semi"), lambda some: ledger.upsert(some, df, keys, version))

    def delete(self, name: str, where: Column) -> str:
        return self.replace(name, where, None)

    def replace(self, name: str, where: Column, rows: DataFrame | None) -> str:
        """Put ``rows`` in the place of those that ``where`` names."""
        goes = F.coalesce(where, F.lit(False))
        stay = lambda some: some.filter(~goes)
        return self._rewrite(name, lambda t: t.filter(goes), stay if rows is None else lambda some: stay(some).unionByName(rows.select(*some.columns)))

    def swap(self, name: str, keys: DataFrame, on: list[str], rows: DataFrame) -> str:
        """Put ``rows`` in the place of those whose ``on`` stands in ``keys``."""
        return self._rewrite(name, lambda t: t.join(keys, on, "left_semi"), lambda some: some.join(keys, on, "left_anti").unionByName(rows.select(*some.columns)))

    def update(self, name: str, values: dict[str, Column], where: Column) -> str:
        return self._rewrite(name, lambda t: t.filter(F.coalesce(where, F.lit(False))), lambda some: ledger.update_where(some, values, where))

    def vacuum(self, name: str, keep: int = 2) -> None:
        """Remove all versions but the last ``keep`` whole ones, and the data files that these don't name.

        To be called when nobody writes: it also removes versions that were never ended and files not yet committed.
        """
        versions = {n: self._version(name, n) for n in self._list(f"{self.root}/{name}/versions")}
        kept = [n for n, lines in versions.items() if lines is not None][-keep:]
        needed = {f.split("/")[1] for n in kept for f in versions[n][1:]}
        for number in versions.keys() - set(kept):
            path, fs = self._file(f"{self.root}/{name}/versions/{number}")
            fs.delete(path, False)
        for folder in self._list(f"{self.root}/{name}/data"):
            if folder not in needed:
                path, fs = self._file(f"{self.root}/{name}/data/{folder}")
                fs.delete(path, True)

    def drop(self, name: str) -> None:
        path, fs = self._file(f"{self.root}/{name}")
        fs.delete(path, True)


class Session:
    """Search, tables, policies, graphs, answers and conversations over a warehouse.

    Tables: clauses (clause_id, policy_id, parent_clause_id, search_text, sequence_no, level, is_active), policies
    (policy_id, title, validity_status, effective_date, expiry_date, family_id, structure_status), vectors (clause_id, embedding),
    catalog (file_id, block_id, table_code, table_title, file_name), cells, candidates, annotations, conversations, messages, feedback.
    ``embed`` gives the vector of a query, ``answer_with`` the text of an answer; both are optional.
    """

    def __init__(self, warehouse: Warehouse, embed=None, answer_with=None):
        self.w, self.spark, self.embed, self.answer_with = warehouse, warehouse.spark, embed, answer_with

    def search(self, query: str, top_k: int = 10, as_of: str | None = None, today: str | None = None) -> DataFrame:
        """Best clauses for a question, fused from both lists, on a day only those that may apply."""
        if not query.strip() or not 1 <= top_k <= 20:
            raise ValueError("a question and a top_k of 1 to 20 are needed")
        k = retrieval.candidate_k(top_k)
        clauses = self.w.read("clauses").filter(F.col("is_active") & F.col("level").isin("article", "paragraph", "item") & (F.trim("search_text") != ""))
        asked = self.spark.createDataFrame([(query,)], "query_text string")
        if self.w.has("lexical_manifest"):
            lists = [(self.lexical.search(asked, k), "bm25_rank")]
        else:
            lists = [(retrieval.bm25(clauses, asked, k, "clause_id", "search_text"), "bm25_rank")]
        if self.embed and self.w.has("vectors"):
            vector = self.spark.createDataFrame([(list(map(float, self.embed(query))),)], "query_vector array<double>")
            lists.append((retrieval.vector_search(self.w.read("vectors"), vector, k, "clause_id"), "vector_rank"))
        fused = retrieval.rrf(lists, "clause_id", k).join(clauses, "clause_id").withColumn("similarity", F.lit(0.0))
        best = retrieval.rerank(fused, F.lit(query), k, fusion=True)
        if as_of is None:
            return best.orderBy(F.desc("score"), "clause_id").limit(top_k)
        day = F.lit(as_of).cast("date")
        return governance.temporal_rank(best, self.w.read("policies"), day, F.lit(today).cast("date") if today else F.current_date(), top_k)

    def context(self, hits: DataFrame) -> DataFrame:
        """Clauses above and below each hit, found from the hits on."""
        wanted = hits.select(F.col("clause_id").cast("string").alias("id"))
        return hierarchy.context(wanted, hierarchy.around(wanted, self.w.read("clauses"), "clause_id", "parent_clause_id"))

    def search_tables(self, query: str, file_id: str | None = None, limit: int = 10) -> DataFrame:
        catalog = self.w.read("catalog")
        catalog = catalog.filter(F.col("file_id") == file_id) if file_id else catalog
        return tables.search_catalog(catalog, query, ["table_code", "table_title", "file_name"], limit, ["file_id", "block_id"])

    def table_data(self, file_id: str, block_id: str, filters=(), limit: int = 100, offset: int = 0) -> DataFrame:
        """A page of an extracted table, its cells pivoted and cast to their types."""
        if not (1 <= limit <= 500 and 0 <= offset <= 10_000):
            raise ValueError("limit is 1 to 500, offset 0 to 10000")
        cells = self.w.read("cells").filter((F.col("file_id") == file_id) & (F.col("block_id") == block_id))
        columns = [(r["key"], r["data_type"]) for r in cells.select("key", "data_type", "col_idx").distinct().orderBy("col_idx").collect()]
        kinds = {"INTEGER": "int", "BIGINT": "long", "DOUBLE PRECISION": "double"}
        rows = cells.groupBy("row_idx").agg(*[F.max(F.when(F.col("key") == k, F.col("value"))).try_cast(kinds.get(t, "string")).alias(k) for k, t in columns])
        return tables.page(rows.filter(tables.compile_filters(rows, list(filters))), ["row_idx"], limit, offset)

    def list_policies(self, query: str = "", status: str = "", limit: int = 30, offset: int = 0) -> DataFrame:
        """A page of policies by title; placeholders without a title or an active clause are hidden."""
        p = self.w.read("policies")
        used = self.w.read("clauses").filter("is_active").select("policy_id").distinct().withColumn("__used", F.lit(True))
        p = p.join(used, "policy_id", "left").filter(~((F.trim("title") == "") & (F.col("structure_status") == "pending") & F.col("__used").isNull())).drop("__used")
        p = p.filter(F.col("title").ilike(f"%{query}%")) if query else p
        p = p.filter(F.col("validity_status") == status) if status else p
        return tables.page(p, ["title", "policy_id"], limit, offset)

    def policy_detail(self, policy_id: str) -> DataFrame:
        """A policy with its active clauses in order, nested."""
        c = self.w.read("clauses").filter((F.col("policy_id") == policy_id) & F.col("is_active"))
        nested = c.groupBy("policy_id").agg(F.array_sort(F.collect_list(F.struct("sequence_no", "clause_id", "level", "search_text"))).alias("clauses"))
        return self.w.read("policies").filter(F.col("policy_id") == policy_id).join(nested, "policy_id", "left")

    def workflow_graph(self, run_id: str) -> tuple[DataFrame, DataFrame]:
        return graphs.workflow_graph(self.w.read("candidates").filter(F.col("run_id") == run_id), self.w.read("annotations").filter(F.col("run_id") == run_id))

    def answer(self, question: str, as_of: str | None = None, today: str | None = None) -> dict:
        """The day, the evidence and an answer; without a provider the conclusion is undetermined."""
        now = F.lit(today).cast("date") if today else F.current_date()
        day = self.spark.range(1).select(rules.answer_date(F.lit(question), F.lit(as_of).cast("date"), now).alias("d")).first()["d"]
        if day["as_of"] is None:
            return {"needs_clarification": True, "source": day["source"], "evidence": [], "conclusion": "undetermined"}
        found = self.search(question, 20, str(day["as_of"]), today)
        found = found.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.when(F.col("temporal_status") == "applicable", 0).otherwise(1), "clause_id")))
        evidence = [r.asDict() for r in retrieval.select_evidence(found).orderBy("evidence_no").collect()]
        said = self.answer_with(question, evidence) if self.answer_with and evidence else "undetermined"
        return {"needs_clarification": False, "as_of": str(day["as_of"]), "source": day["source"], "evidence": evidence, "conclusion": said}

    def save_message(self, token: str, conversation_id: str, message_id: str, question: str, answer: str, at: str) -> None:
        """Append a message to the owner's conversation and name it by its first question; others' raise ValueError."""
        mine = self.w.read("conversations").filter((F.col("conversation_id") == conversation_id) & (F.col("owner_hash") == owner_hash(F.lit(token))))
        if mine.isEmpty():
            raise ValueError("no such conversation")
        row = mine.select("conversation_id", F.lit(message_id).alias("message_id"), F.lit(question).alias("question"), F.lit(answer).alias("answer"), F.lit(at).cast("timestamp").alias("created_at"))
        self.w.append("messages", row)
        here = F.col("conversation_id") == conversation_id
        self.w.update("conversations", {"title": F.when(F.trim("title") == "", F.substring(F.lit(question), 1, 30)).otherwise(F.col("title")), "updated_at": F.lit(at).cast("timestamp")}, here)

    def list_conversations(self, token: str, limit: int = 100) -> DataFrame:
        return self.w.read("conversations").filter(F.col("owner_hash") == owner_hash(F.lit(token))).orderBy(F.desc("updated_at"), "conversation_id").limit(limit)

    def delete_conversation(self, token: str, conversation_id: str) -> None:
        """Delete the owner's conversation and all that belongs to it."""
        mine = self.w.read("conversations").filter((F.col("conversation_id") == conversation_id) & (F.col("owner_hash") == owner_hash(F.lit(token))))
        if mine.isEmpty():
            return
        for name in ("messages", "conversations"):
            if self.w.has(name):
                self.w.delete(name, F.col("conversation_id") == conversation_id)

    def rate(self, token: str, message_id: str, rating: str, at: str) -> None:
        """The owner's rating of a message, the last one counts."""
        if rating not in ("up", "down"):
            raise ValueError("a rating is up or down")
        mine = self.w.read("messages").filter(F.col("message_id") == message_id).join(self.w.read("conversations").filter(F.col("owner_hash") == owner_hash(F.lit(token))), "conversation_id")
        row = mine.select("message_id", F.lit(rating).alias("rating"), F.lit(at).cast("timestamp").alias("rated_at"))
        if row.isEmpty():
            raise ValueError("no such message")
        self.w.upsert("feedback", row, ["message_id"], "rated_at")

    def sync_vectors(self, policy_id: str, vectors: DataFrame) -> None:
        """Replace the vectors of one policy; none leaves it without.  Files without rows of the policy stay."""
        if self.w.has("vectors"):
            self.w.replace("vectors", F.col("policy_id") == policy_id, vectors)
        else:
            self.w.write("vectors", vectors)

    def warm_up(self) -> dict[str, dict]:
        """Try the query model and cache the index's terms; a stage that fails is told and fails no other."""

        def terms() -> dict:
            return {"terms": self.w.read("lexical_counts").cache().select("term").distinct().count()}

        def model() -> dict:
            return {"dimensions": len(self.embed("warm up"))} if self.embed else {}

        report = {}
        for stage, work in (("embedding", model), ("lexical", terms)):
            began = time.perf_counter()
            try:
                report[stage] = {"status": "ready"} | work()
            except Exception as e:  # noqa: BLE001 - a provider may fail in any way, and the first search tries again
                report[stage] = {"status": "failed", "error": str(e)}
            report[stage]["seconds"] = round(time.perf_counter() - began, 4)
        return report

    @property
    def lexical(self) -> segments.SegmentIndex:
        """The stored index of clauses, with its runs and items."""
        return segments.SegmentIndex(self.w)

    def index_policies(self, embed: Callable[[DataFrame], DataFrame] | None = None, run_id: str | None = None, at: str | None = None) -> int:
        """Bring the lexical index and the vectors up to date and return how many policies that took.

        ``embed`` gives (policy_id, clause_id, embedding) of clauses; it goes first, so a model that fails leaves both
        indexes as they were, and a run that stopped between them does both again.  Full tiers of segments are merged.
        """
        clauses = self.w.read("clauses").filter(F.col("is_active") & F.col("level").isin("article", "paragraph", "item") & (F.trim("search_text") != ""))
        index = self.lexical
        if embed:
            todo = staging.cut(index.pending(clauses).select(F.col("item").alias("policy_id")))
            if not todo.isEmpty():
                rows = embed(clauses.join(todo, "policy_id", "left_semi"))
                if self.w.has("vectors"):
                    self.w.swap("vectors", todo, ["policy_id"], staging.cut(rows))
                else:
                    self.w.write("vectors", rows)
        run = index.update(clauses, run_id or uuid.uuid4().hex, at or time.strftime("%Y-%m-%d %H:%M:%S"), resume=True)
        index.compact()
        return run["done"]
