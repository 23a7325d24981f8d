"""Collections on disk: an append-only Parquet log, read at a version, committed by publishing a manifest.

A collection's folder has schema.json, versions/N.json (manifests), log/ and sealed/ (Parquet, a folder a commit) and
receipts/. A manifest names the segments that make up its version; a writer that finds its version taken gives way.
"""

from __future__ import annotations

import json
import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantor import config as c
from vantor.errors import Closed, Conflict, EngineError, InvalidArgument, NotFound, NotSupported
from vantor.functions.filters import compile_map_filter
from vantor.operators import search as s
from vantor.operators.mutations import FAILED, latest, numbered, receipts, statuses
from vantor.operators.quantize import SHORTLIST, OneBit, matrix_rotation, onebit_encode, two_stage_search
from vantor.sources.shared import Files, cut

CELL = "struct<b:boolean,i:bigint,d:double,s:string>"
RECEIPT = "pos long, id string, status string, batch_op_id long, row_op_id long, visibility_watermark long, searchable boolean"
#: A graph index wants more rows than this.
MIN_GRAPH_ROWS = 32
#: Idempotency keys that a manifest holds itself, ledger files that it names, before they are merged.
MAX_KEYS, MAX_LEDGERS = 256, 16


def cell(value: bool | float | str) -> tuple:
    return (value if isinstance(value, bool) else None, value if isinstance(value, int) and not isinstance(value, bool) else None, value if isinstance(value, float) else None, value if isinstance(value, str) else None)


def connect(spark: SparkSession, path: str | None = None, read_only: bool = False) -> Engine:
    """The engine over a folder; without a path (or ":memory:") over a temporary one. Read-only needs one that exists."""
    if path is not None and not isinstance(path, str):
        raise InvalidArgument("path must be a string")
    if path in (None, ":memory:"):
        if read_only:
            raise InvalidArgument("a temporary engine can't be read-only")
        shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not spark.sparkContext.master.startswith("local["):
            raise InvalidArgument("set spark.checkpoint.dir to a folder that all executors share, or give a path")
        path = tempfile.mkdtemp(prefix="vantor-") if shared is None else f"{shared.rstrip('/')}/collections-{uuid.uuid4().hex}"
    engine = Engine(spark, path.rstrip("/"), read_only)
    if read_only and not engine.files.exists(engine.path):
        raise NotFound(f"{path} does not exist", "open")
    return engine


@dataclass
class SearchResult:
    """hits: (query_id, rank, id, distance); queries in their order; the version and watermark that were read."""

    hits: DataFrame
    queries: DataFrame
    limit: int
    watermark: int
    plan: str
    effort: int | None
    report: dict
    visible: DataFrame
    admitted: DataFrame

    def completeness(self) -> DataFrame:
        return s.completeness(self.hits, self.queries, self.limit, self.report["short"] or bool(self.report["segments_failed"]))

    def stats(self) -> dict:
        """What the search did, as far as that is the same each time; rows are counted when this is asked for."""
        return {k: v for k, v in self.report.items() if k != "short"} | {"strategy": self.plan, "filter_examined": self.visible.count(), "filter_passed": self.admitted.count(), "reranked": self.report["candidates"]}

    def csr(self) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(ids, distances, offsets) of all queries, on the driver."""
        ids, distances, offsets = [], [], [0]
        for r in s.csr(self.hits, self.queries).orderBy("query_id").collect():  # limit rows a query
            ids += r.ids
            distances += r.distances
            offsets.append(len(ids))
        return ids, np.array(distances, dtype=np.float32), np.array(offsets)

    def payloads(self, collection: Collection) -> DataFrame:
        return s.payloads(self.hits, collection.records())


class Engine:
    """A folder of collections."""

    def __init__(self, spark: SparkSession, path: str, read_only: bool = False) -> None:
        self.spark, self.path, self.read_only = spark, path, read_only
        self.files = Files(spark, path)
        self._open: dict[str, list[Collection]] = {}
        self._closed = self._draining = False
        self._writes, self._idle = 0, threading.Condition()

    def _check(self, writing: bool = False) -> None:
        if self._closed or (writing and self._draining):
            raise Closed("the engine is closed", "admission")
        if writing and self.read_only:
            raise NotSupported("the engine is read-only", "admission", "readonly_instance")

    def list_collections(self) -> list[str]:
        self._check()
        return [n for n in self.files.names(self.path) if c.NAME.fullmatch(n) and self.files.exists(f"{self.path}/{n}/schema.json")]

    def create_collection(self, name: str, config: c.CollectionConfig) -> Collection:
        self._check(writing=True)
        if not isinstance(config, c.CollectionConfig):
            raise InvalidArgument("config must be a CollectionConfig")
        c.check_name(name)
        c.check_platform(config)
        folder = f"{self.path}/{name}"
        self.files.mkdirs(f"{folder}/versions")
        if not self.files.publish(f"{folder}/schema.json", json.dumps(config.to_dict())):
            raise Conflict(f"collection {name!r} exists", "open", "already_exists")
        first = {"version": 0, "watermark": 0, "durable": 0, "next_op": 1, "history_from": 0, "segments": [], "retired": [], "keys": {}}
        self.files.publish(f"{folder}/versions/{0:012d}.json", json.dumps(first))
        return self.open_collection(name)

    def open_collection(self, name: str, read_only: bool = False) -> Collection:
        self._check()
        if not self.files.exists(f"{self.path}/{c.check_name(name)}/schema.json"):
            raise NotFound(f"no collection {name!r}", "open")
        found = Collection(self, name, read_only or self.read_only)
        self._open.setdefault(name, []).append(found)
        return found

    def drop_collection(self, name: str, missing_ok: bool = False) -> None:
        self._check(writing=True)
        folder = f"{self.path}/{c.check_name(name)}"
        if not self.files.exists(f"{folder}/schema.json"):
            if missing_ok:
                return
            raise NotFound(f"no collection {name!r}", "open")
        if any(not x.closed for x in self._open.get(name, [])):
            raise Conflict(f"collection {name!r} is open", "close")
        self.files.delete(folder)

    @contextmanager
    def _admitted(self) -> Iterator[None]:
        """A write that drain() waits for."""
        with self._idle:
            self._check(writing=True)
            self._writes += 1
        try:
            yield
        finally:
            with self._idle:
                self._writes -= 1
                self._idle.notify_all()

    def drain(self, timeout: float | None = None) -> bool:
        """Refuse new writes from now on and wait for those that have begun; whether all have ended."""
        with self._idle:
            self._draining = True
            return self._idle.wait_for(lambda: self._writes == 0, timeout)

    def close(self) -> None:
        self.drain()
        for opened in self._open.values():
            for x in opened:
                x.close()
        self._closed = True

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


class Collection:
    """A named set of records (id, vector, document, metadata, version)."""

    cell = CELL

    def __init__(self, engine: Engine, name: str, read_only: bool) -> None:
        self.engine, self.name, self.read_only, self.closed = engine, name, read_only, False
        self.spark, self.files, self.path = engine.spark, engine.files, f"{engine.path}/{name}"
        self._ledgers: dict[str, dict] = {}
        # rebuild_index() changes the configuration with the version that has the new index
        self.config = c.CollectionConfig.from_dict(self._manifest().get("config") or json.loads(self.files.read(f"{self.path}/schema.json")))
        self.schema = f"id string, seq bigint, op string, vector array<{self.config.element}>, document string, metadata map<string,{CELL}>"

    # versions

    def _require(self, writing: bool = False) -> None:
        if self.closed or self.engine._closed:
            raise Closed("the collection is closed", "admission")
        if writing and self.read_only:
            raise NotSupported("the collection is read-only", "admission", "readonly_instance")

    def _manifest(self) -> dict:
        names = [n for n in self.files.names(f"{self.path}/versions") if n.endswith(".json")]
        return json.loads(self.files.read(f"{self.path}/versions/{names[-1]}"))

    def _commit(self, manifest: dict, **changes: object) -> dict:
        new = manifest | changes | {"version": manifest["version"] + 1}
        if not self.files.publish(f"{self.path}/versions/{new['version']:012d}.json", json.dumps(new)):
            raise Conflict(f"version {new['version']} was written by another", "mutation_publish")
        return new

    def _read(self, segments: list[dict]) -> DataFrame:
        """The rows of segments; of one that has after or upto only those above and up to that seq."""
        whole = [x for x in segments if "after" not in x and "upto" not in x]
        read = self.spark.read.schema(self.schema).parquet
        out = read(*[f"{self.path}/{x['path']}" for x in whole]) if whole else self.spark.createDataFrame([], self.schema)
        for x in segments:
            if x not in whole:
                own = read(f"{self.path}/{x['path']}").where(F.col("seq") > x.get("after", 0))
                out = out.unionByName(own.where(F.col("seq") <= x["upto"]) if "upto" in x else own)
        return out

    def log(self, manifest: dict | None = None) -> DataFrame:
        """All rows of the segments: id, seq, op, vector, document, metadata."""
        return self._read((manifest or self._manifest())["segments"])

    def records(self, watermark: int | None = None, manifest: dict | None = None) -> DataFrame:
        """The live records (id, vector, document, metadata, version), now or as of a watermark."""
        self._require()
        manifest = manifest or self._manifest()
        if watermark is not None and watermark < manifest["history_from"]:
            raise NotFound(f"versions before {manifest['history_from']} are gone", "search")
        rows = latest(self.log(manifest), watermark).where("op = 'write'")
        return rows.select("id", "vector", "document", "metadata", F.col("seq").alias("version"))

    # reads

    def scan(self, where: dict | None = None, limit: int = 100, include_vector: bool = False) -> DataFrame:
        """The first `limit` records in byte order of id."""
        c.positive_int(limit, "limit")
        columns = ["id", "document", "metadata", "version", *["vector"] * include_vector]
        return self.records().where(compile_map_filter(where or {})).select(*columns).orderBy("id").limit(limit)

    def get(self, ids: Sequence[str], include_vector: bool = False) -> DataFrame:
        """(pos, wanted, found, record columns): a row for each id asked for, in order; found is false where there is none."""
        wanted = c.check_ids(ids, allow_empty=True)
        asked = self.spark.createDataFrame(list(enumerate(wanted)), "pos long, wanted string")
        columns = ["id", "document", "metadata", "version", *["vector"] * include_vector]
        found = self.records().select(*columns)
        return asked.join(found, F.col("wanted") == F.col("id"), "left").withColumn("found", F.col("id").isNotNull()).drop("id").orderBy("pos")

    def info(self) -> dict:
        """The configuration, what it is stored as, and the version that reads see."""
        m = self._manifest()
        return {"config": self.config.to_dict(), "format": "parquet", "version": m["version"], "segments": len(m["segments"]), "coded_segments": sum("codes" in x for x in m["segments"])}

    def count(self) -> int:
        return self.records().count()

    def __len__(self) -> int:
        return self.count()

    def stats(self) -> dict:
        m = self._manifest()
        rows = latest(self.log(m)).agg(F.count_if(F.col("op") == "write").alias("size"), F.count_if(F.col("op") == "delete").alias("tombstones")).first()
        width = np.dtype(self.config.dtype).itemsize
        kinds = [x["kind"] for x in m["segments"]]
        return {"size": rows["size"], "tombstones": rows["tombstones"], "accepted": m["next_op"] - 1, "visibility_watermark": m["watermark"], "durable_watermark": m["durable"], "metadata_epoch": m["version"], "vector_bytes": rows["size"] * self.config.dimension * width, "sealed_segments": kinds.count("sealed"), "log_segments": kinds.count("log"), "retired_segments": len(m["retired"])}

    def search(self, queries: object, limit: int = 10, where: dict | None = None, effort: int | None = None, filter_policy: str = "auto", selectivity_hint: float | None = None, scratch_bytes: int | None = None) -> SearchResult:
        """The nearest records of one vector or a matrix of them, numbered in order, or of a DataFrame (query_id, query).

        Without a graph index answers are exact over what passes the filter. With one, unsealed rows are all measured;
        of sealed rows candidates are found by one-bit codes and then measured exactly. By the filter's selectivity (the
        hint, or that of the first rows in order of id) all that passes is measured (prefilter, and always if
        filter_policy is strict), only codes of what passes are looked at (traversal), or the hits of an unfiltered
        search are filtered, with twice as many while they don't suffice (postfilter); where these end short, what
        passes is measured after all, unless filter_policy is allow_partial. allow_partial also goes on without
        segments that can't be read.
        """
        self._require()
        c.positive_int(limit, "limit")
        effort = c.effective_effort(self.config, effort, limit)
        if filter_policy not in ("auto", "strict", "allow_partial"):
            raise InvalidArgument("filter_policy must be auto, strict or allow_partial")
        if selectivity_hint is not None and not (isinstance(selectivity_hint, int | float) and 0 <= selectivity_hint <= 1):
            raise InvalidArgument("selectivity_hint must lie in [0, 1]")
        if isinstance(queries, DataFrame):
            asked = queries.select("query_id", F.col("query").cast("array<float>").alias("query"))
            n_queries = asked.count()
        else:
            q = c.check_queries(queries, self.config)
            n_queries = len(q)
            asked = self.spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(q)], "query_id int, query array<float>")
        m = self._manifest()
        partial = filter_policy == "allow_partial"
        m, failed = self._readable(m) if partial else (m, [])
        if scratch_bytes is not None:
            s.preflight(n_queries, self.count(), limit, self.config.dimension, scratch_bytes)
        records = self.records(manifest=m)
        columns = ["id", "version", F.col("vector").cast("array<float>").alias("vector")]
        visible = records.select(*columns)
        admitted = records.where(compile_map_filter(where)).select(*columns) if where else visible
        coded = [x for x in m["segments"] if "codes" in x]
        report = {"segments": len(m["segments"]), "segments_failed": failed, "selectivity": None, "overfetch_rounds": 0, "candidates": 0, "short": False}
        exact = lambda rows: s.search(rows, asked, limit, self.config.metric)
        done = lambda hits, plan: SearchResult(hits, asked, limit, m["watermark"], plan, effort, report, visible, admitted)
        if not coded:
            return done(exact(admitted), "prefilter" if where else "postfilter")
        plan = "postfilter"
        if where:
            share = selectivity_hint
            if share is None and filter_policy != "strict":
                share = s.selectivity(records, compile_map_filter(where)).first().selectivity
            report["selectivity"] = share
            plan = self.spark.range(1).select(s.filter_plan(share or 0.0, strict=filter_policy == "strict").alias("p")).first().p
        if plan == "prefilter":
            return done(exact(admitted), plan)
        report["candidates"] = limit * max(SHORTLIST, -(-effort // limit)) * len(coded) * n_queries
        if not where or plan == "traversal":
            return done(self._coded(m, coded, admitted, asked, limit, effort), plan)
        hits = s.overfetch(lambda n: self._coded(m, coded, visible, asked, n, effort), admitted, limit, report=report)
        if report["short"] and not partial:
            report["short"] = False
            return done(exact(admitted), "prefilter")
        return done(hits, plan)

    def _coded(self, m: dict, coded: list[dict], rows: DataFrame, asked: DataFrame, limit: int, effort: int) -> DataFrame:
        """The nearest of rows: through their codes where they have some, else exactly."""
        parts, rest = [], rows
        for x in coded:
            codes = self.spark.read.parquet(f"{self.path}/{x['codes']}")
            own = rows.join(codes.select("id", F.col("seq").alias("version")), ["id", "version"], "left_semi")
            alive = codes.join(rows.select("id", F.col("version").alias("seq")), ["id", "seq"], "left_semi")
            model = OneBit(np.array(x["centre"]), matrix_rotation(self.config.dimension), x.get("unit", False))
            parts.append(two_stage_search(own, alive, model, asked, limit, self.config.metric, max(SHORTLIST, -(-effort // limit))))
            rest = rest.join(codes.select("id", F.col("seq").alias("version")), ["id", "version"], "left_anti")
        parts.append(s.search(rest, asked, limit, self.config.metric))
        return s.merge_segments(parts, limit)

    def _readable(self, m: dict) -> tuple[dict, list[str]]:
        """The manifest without segments whose files can't be opened, and their paths."""
        failed = []
        for x in m["segments"]:
            try:
                for path in _paths([x]):
                    self.spark.read.parquet(f"{self.path}/{path}")
            except (AnalysisException, Py4JJavaError):
                failed.append(x["path"])
        return m | {"segments": [x for x in m["segments"] if x["path"] not in failed]}, failed

    # writes

    def _rows(self, ids: object, vectors: object, documents: object, metadata: object) -> DataFrame:
        names = c.check_ids(ids)
        v = c.check_vectors(vectors, len(names), self.config)
        docs, meta = c.check_documents(documents, len(names)), c.check_metadata(metadata, len(names))
        kind = float if self.config.dtype == "float32" else int
        rows = [(k, i, [kind(x) for x in v[k]], docs[k], {key: cell(x) for key, x in meta[k].items()}) for k, i in enumerate(names)]
        return self.spark.createDataFrame(rows, f"pos long, id string, vector array<{self.config.element}>, document string, metadata map<string,{CELL}>")

    def add(self, ids: object, vectors: object, documents: object = None, metadata: object = None, mode: str = "atomic", idempotency_key: str | None = None) -> DataFrame:
        return self.write(self._rows(ids, vectors, documents, metadata), "add", mode, idempotency_key)

    def replace(self, ids: object, vectors: object, documents: object = None, metadata: object = None, mode: str = "atomic", idempotency_key: str | None = None) -> DataFrame:
        return self.write(self._rows(ids, vectors, documents, metadata), "replace", mode, idempotency_key)

    def upsert(self, ids: object, vectors: object, documents: object = None, metadata: object = None, mode: str = "atomic", idempotency_key: str | None = None) -> DataFrame:
        return self.write(self._rows(ids, vectors, documents, metadata), "upsert", mode, idempotency_key)

    def delete(self, ids: object, mode: str = "atomic", idempotency_key: str | None = None) -> DataFrame:
        rows = self.spark.createDataFrame(list(enumerate(c.check_ids(ids))), "pos long, id string")
        return self.write(rows, "delete", mode, idempotency_key)

    def delete_where(self, where: dict, batch_size: int = 1000) -> dict:
        """Tombstones for all records that match now, in batches of batch_size ids, each a commit of its own.

        Returns matched, deleted, not_found (rows that were gone when their batch came) and the number of batches.
        """
        c.positive_int(batch_size, "batch_size")
        if not where:
            raise InvalidArgument("delete_where needs a filter")
        ids = cut(numbered(self.records().where(compile_map_filter(where)).select("id"), ["id"], "pos"))
        n, at = ids.count(), 0
        found = {"deleted": 0, "not_found": 0}
        while at < n:
            at = self._delete_batches(ids, at, n, batch_size, found)
        return {"matched": n, **found, "batches": -(-n // batch_size)}

    def _delete_batches(self, ids: DataFrame, start: int, n: int, size: int, found: dict[str, int]) -> int:
        """Commit the batches of ids (id, pos) from pos start on; where it ended, before n if another has written meanwhile.

        The tombstones of all batches are written at once, numbered as batches of their own would number them. The commit of
        a batch is then a manifest that shows the folder up to the batch's last one, so that no batch takes a job.
        """
        self._require(writing=True)
        m, name = self._manifest(), uuid.uuid4().hex
        live = latest(self.log(m)).where("op = 'write'").select("id")
        nth = F.floor((F.col("pos") - start) / size).cast("long")
        rows = ids.where(F.col("pos") >= start).withColumn("batch", nth).withColumn("seq", F.lit(m["next_op"] + 1 - start) + F.col("pos") + F.col("batch"))
        good = rows.join(live, "id", "left_semi")
        cells = {"vector": f"array<{self.config.element}>", "document": "string", "metadata": f"map<string,{CELL}>"}
        tombs = good.select("id", "seq", F.lit("delete").alias("op"), *[F.lit(None).cast(t).alias(k) for k, t in cells.items()])
        tombs.repartitionByRange("seq").sortWithinPartitions("seq").write.parquet(f"{self.path}/log/{name}")
        counted = cut(good.groupBy("batch").agg(F.count("*").alias("ok"), F.max("seq").alias("last")).orderBy("batch")).toLocalIterator()
        at, shown, after, ahead = start, 0, None, next(counted, None)
        while at < n:
            places = min(size, n - at)
            ok, changes = 0, {"next_op": m["next_op"] + 1 + places}
            if ahead is not None and ahead["batch"] == (at - start) // size:
                ok, last, ahead = ahead["ok"], ahead["last"], next(counted, None)
                others = [x for x in m["segments"] if x["path"] != f"log/{name}"]
                ends = ({} if after is None else {"after": after}) | ({} if ahead is None else {"upto": last})
                changes |= {"segments": [*others, {"path": f"log/{name}", "kind": "log", "rows": shown + ok} | ends], "watermark": last, "durable": last}
            try:
                with self.engine._admitted():
                    self._require(writing=True)
                    m = self._commit(m, **changes)
            except EngineError as e:
                if at == start:
                    self.files.delete(f"{self.path}/log/{name}")
                if isinstance(e, Conflict) and at > start:
                    return at
                raise
            at, shown = at + places, shown + ok
            found["deleted"] += ok
            found["not_found"] += places - ok
            if self._auto_seal(m, ok):
                sealed = self._manifest()
                if (sealed["version"], sealed["next_op"]) != (m["version"] + 1, m["next_op"]):
                    return at
                m, shown, after = sealed, 0, m["watermark"]
        if not found["deleted"]:
            self.files.delete(f"{self.path}/log/{name}")
        return at

    def delete_by_filter(self, where: dict) -> dict:
        """delete_where() with a commit for each record, in order of id."""
        return self.delete_where(where, batch_size=1)

    def write(self, rows: DataFrame, op: str, mode: str = "atomic", idempotency_key: str | None = None) -> DataFrame:
        """Apply a batch of any size: rows has pos and id, and vector, document, metadata unless op is delete.

        pos numbers the rows from 0, each once; operation ids follow it, gaps included.

        Returns the receipts. Statuses are joins against the live ids; rows that succeed become a log segment, which
        counts once its manifest is published.
        """
        self._require(writing=True)
        with self.engine._admitted():
            return self._write(rows, op, mode, idempotency_key)

    def _write(self, rows: DataFrame, op: str, mode: str, idempotency_key: str | None) -> DataFrame:
        if mode not in ("atomic", "partial"):
            raise InvalidArgument("mode must be atomic or partial")
        if idempotency_key is not None and (not isinstance(idempotency_key, str) or not idempotency_key):
            raise InvalidArgument("idempotency_key must be None or a non-empty string")
        m = self._manifest()
        if idempotency_key is not None and (before := self._receipts_of(m, idempotency_key)):
            return self.spark.read.schema(RECEIPT).parquet(f"{self.path}/{before}").orderBy("pos")
        valid = F.lit(True)
        if op != "delete":
            valid = F.coalesce((F.size("vector") == self.config.dimension) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x.cast("double"))), F.lit(False))
        batch = rows.select("pos", "id", F.lit(op).alias("op"), (valid & F.col("id").isNotNull()).alias("valid"))
        done = statuses(batch, latest(self.log(m)).where("op = 'write'").select("id"), mode, deletes=op == "delete")
        done = cut(receipts(done, m["next_op"], m["watermark"]))
        total = done.agg(F.count("*").alias("n"), F.count_if("searchable").alias("ok"), F.max(F.when(F.col("searchable"), F.col("row_op_id"))).alias("last"), F.coalesce(F.max("pos") + 1, F.lit(0)).alias("places")).first()
        changes: dict = {"next_op": m["next_op"] + 1 + total["places"]}
        name = uuid.uuid4().hex
        if total["ok"]:
            cells = [F.col(k) for k in ("vector", "document", "metadata")] if op != "delete" else []
            good = rows.join(done.where("searchable").select("pos", F.col("row_op_id").alias("seq")), "pos")
            columns = {"vector": f"array<{self.config.element}>", "document": "string", "metadata": f"map<string,{CELL}>"}
            values = [F.lit(None).cast(t).alias(k) for k, t in columns.items()] if not cells else [F.col("vector"), F.coalesce("document", F.lit("")).alias("document"), F.col("metadata")]
            good = good.select("id", "seq", F.lit("delete" if op == "delete" else "write").alias("op"), *values)
            good.write.parquet(f"{self.path}/log/{name}")
            changes |= {"segments": [*m["segments"], {"path": f"log/{name}", "kind": "log", "rows": total["ok"]}], "watermark": total["last"], "durable": total["last"]}
        if idempotency_key is not None:
            done.write.parquet(f"{self.path}/receipts/{name}")
            changes |= self._with_key(m, idempotency_key, f"receipts/{name}")
        try:
            new = self._commit(m, **changes)
        except Conflict:
            for folder in ("log", "receipts"):
                self.files.delete(f"{self.path}/{folder}/{name}")
            raise
        self._auto_seal(new, total["ok"])
        return done.orderBy("pos")

    def _auto_seal(self, m: dict, ok: int) -> bool:
        """Seal after a write of so many rows if the log is long enough for that; whether it was sealed."""
        limit = self.config.auto_seal_rows
        if limit is None or not ok or sum(x["rows"] for x in m["segments"] if x["kind"] == "log") < limit:
            return False
        try:
            self.seal()
        except EngineError:  # the write itself has succeeded
            return False
        return True

    def _receipts_of(self, m: dict, key: str) -> str | None:
        """Where the receipts of a batch with this key are, if there was one."""
        if key in m["keys"]:
            return m["keys"][key]
        return next((x[key] for x in map(self._ledger, m.get("ledgers", [])) if key in x), None)

    def _ledger(self, name: str) -> dict:
        if name not in self._ledgers:
            self._ledgers[name] = json.loads(self.files.read(f"{self.path}/{name}"))
        return self._ledgers[name]

    def _with_key(self, m: dict, key: str, receipts_path: str) -> dict:
        """The manifest's changes for one more key: MAX_KEYS of them go into a file, and MAX_LEDGERS files into one."""
        keys, ledgers = m["keys"] | {key: receipts_path}, m.get("ledgers", [])
        if len(keys) > MAX_KEYS:
            if len(ledgers) >= MAX_LEDGERS:
                for x in ledgers:
                    keys = self._ledger(x) | keys
                ledgers = []
            name = f"ledger/{uuid.uuid4().hex}.json"
            self.files.mkdirs(f"{self.path}/ledger")
            self.files.write(f"{self.path}/{name}", json.dumps(keys))
            keys, ledgers = {}, [*ledgers, name]
        return {"keys": keys, "ledgers": ledgers}

    # maintenance

    def _image(self, rows: DataFrame, with_codes: bool) -> dict:
        """Write rows as a sealed segment, in order of id; with codes for a graph index."""
        name = uuid.uuid4().hex
        rows.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{self.path}/sealed/{name}")
        written = self._read([{"path": f"sealed/{name}"}])
        segment = {"path": f"sealed/{name}", "kind": "sealed", "rows": written.count()}
        if with_codes:
            live = written.where("op = 'write'").select("id", "seq", F.col("vector").cast("array<float>").alias("vector"))
            model = OneBit.fit(live, self.config.dimension, unit=self.config.metric == "cosine")
            coded = onebit_encode(live, model).join(live.select("id", "seq"), "id")
            coded.write.parquet(f"{self.path}/sealed/{name}-codes")
            segment |= {"codes": f"sealed/{name}-codes", "centre": [float(x) for x in model.centre], "unit": model.unit}
        return segment

    def prepare_seal(self) -> dict:
        """Write the log as a sealed segment of one row an id, beside what is read; install() puts it in place of the log.

        Writes may go on meanwhile: their log segments stay and count for more.
        """
        self._require(writing=True)
        m = self._manifest()
        active = [x for x in m["segments"] if x["kind"] == "log"]
        if not active:
            raise InvalidArgument("there is nothing to seal", "freeze")
        graph = isinstance(self.config.index, c.GraphIndex)
        if graph and self.count() <= MIN_GRAPH_ROWS:
            raise InvalidArgument(f"a graph index needs more than {MIN_GRAPH_ROWS} live rows", "freeze")
        return {"segment": self._image(latest(self._read(active)), graph), "replaces": [x["path"] for x in active], "read": active, "history_from": m["watermark"]}

    def install(self, prepared: dict) -> dict:
        """Put a prepared segment in place of those it was made of; Conflict if one of these is gone."""
        self._require(writing=True)
        m = self._manifest()
        old = [x for x in m["segments"] if x["path"] in prepared["replaces"]]
        if len(old) != len(prepared["replaces"]):
            raise Conflict("segments were changed since", "install")
        at = m["segments"].index(old[0])
        kept = [x for x in m["segments"] if x not in old]
        # a folder that shows more since it was read stays with what is new
        read = {x["path"]: x for x in prepared["read"]}
        if any(x.get("after") != read[x["path"]].get("after") for x in old):
            raise Conflict("segments were changed since", "install")
        grown = [x | {"rows": x["rows"] - read[x["path"]]["rows"], "after": read[x["path"]]["upto"]} for x in old if x != read[x["path"]]]
        segments = [*kept[:at], prepared["segment"], *grown, *kept[at:]]
        new = self._commit(m, segments=segments, retired=m["retired"] + _paths(old), history_from=max(m["history_from"], prepared["history_from"]))
        return {"version": new["version"], "rows": prepared["segment"]["rows"], "segments": len(new["segments"])}

    def seal(self) -> dict:
        """Turn the log into a sealed segment of one row an id."""
        return self.install(self.prepare_seal())

    def compact(self) -> dict:
        """Merge the sealed segments, if there are two or more, into one without tombstones."""
        self._require(writing=True)
        m = self._manifest()
        sealed = [x for x in m["segments"] if x["kind"] == "sealed"]
        if len(sealed) < 2:
            return {"version": m["version"], "merged": 0}
        segment = self._image(latest(self._read(sealed)).where("op = 'write'"), isinstance(self.config.index, c.GraphIndex))
        rest = [x for x in m["segments"] if x["kind"] != "sealed"]
        new = self._commit(m, segments=[segment, *rest], retired=m["retired"] + _paths(sealed), history_from=m["watermark"])
        return {"version": new["version"], "merged": len(sealed)}

    def checkpoint(self) -> dict:
        """Write the live rows as one segment and forget older versions; the idempotency ledger stays."""
        self._require(writing=True)
        m = self._manifest()
        segments = m["segments"]
        if len(segments) > 1 or any(x["kind"] == "log" for x in segments):
            n = self.count()
            codes = isinstance(self.config.index, c.GraphIndex) and n > MIN_GRAPH_ROWS
            new = [self._image(latest(self.log(m)).where("op = 'write'"), codes)] if n else []
            m = self._commit(m, segments=new, retired=m["retired"] + _paths(segments), history_from=m["watermark"], durable=m["watermark"])
        for n in self.files.names(f"{self.path}/versions"):
            if n.endswith(".json") and int(n[:-5]) < m["version"]:
                self.files.delete(f"{self.path}/versions/{n}")
        return {"version": m["version"], "durable_watermark": m["watermark"]}

    def collect_garbage(self) -> dict:
        """Delete what neither the current version nor a snapshot refers to, folders of failed writers among it.

        What only a snapshot refers to is deferred to a later call.
        """
        self._require(writing=True)
        m = self._manifest()
        named: set[str] = set()
        for n in self.files.names(f"{self.path}/versions"):
            if n.endswith(".json"):
                v = json.loads(self.files.read(f"{self.path}/versions/{n}"))
                named |= set(_paths(v["segments"])) if v["version"] == m["version"] else set()
        named |= set(m["keys"].values()) | set(m.get("ledgers", [])) | {p for x in m.get("ledgers", []) for p in self._ledger(x).values()}
        pinned = {p for x in self.files.names(f"{self.path}/pins") for p in json.loads(self.files.read(f"{self.path}/pins/{x}"))["paths"]}
        old = [f"{k}/{x}" for k in ("log", "sealed", "receipts", "ledger") for x in self.files.names(f"{self.path}/{k}") if f"{k}/{x}" not in named]
        gone = [x for x in old if x not in pinned]
        for x in gone:
            self.files.delete(f"{self.path}/{x}")
        self._commit(m, retired=[x for x in old if x in pinned])
        return {"deleted": len(gone), "deferred": len(old) - len(gone)}

    @contextmanager
    def snapshot(self) -> Iterator[DataFrame]:
        """The records as they are now; until the block ends their files are pinned against collect_garbage()."""
        self._require()
        m = self._manifest()
        pin = f"{self.path}/pins/{uuid.uuid4().hex}.json"
        self.files.mkdirs(f"{self.path}/pins")
        self.files.write(pin, json.dumps({"version": m["version"], "paths": _paths(m["segments"])}))
        try:
            yield self.records(manifest=m)
        finally:
            self.files.delete(pin)

    def retire_segment(self, path: str) -> None:
        """Take a segment out of the current version."""
        self._require(writing=True)
        m = self._manifest()
        gone = [x for x in m["segments"] if x["path"] == path]
        if not gone:
            raise NotFound(f"no segment {path!r}")
        self._commit(m, segments=[x for x in m["segments"] if x["path"] != path], retired=m["retired"] + _paths(gone))

    def rebuild_index(self, index: c.FlatIndex | c.GraphIndex | None = None) -> dict:
        """Rewrite all live rows under another index, or the same one anew."""
        self._require(writing=True)
        index = index or self.config.index
        if not isinstance(index, c.FlatIndex | c.GraphIndex):
            raise InvalidArgument("index must be a FlatIndex or a GraphIndex")
        new = c.CollectionConfig(self.config.dimension, self.config.dtype, self.config.metric, index, self.config.auto_seal_rows)
        c.check_platform(new)
        graph = isinstance(index, c.GraphIndex)
        n = self.count()
        if graph and n <= MIN_GRAPH_ROWS:
            raise InvalidArgument(f"a graph index needs more than {MIN_GRAPH_ROWS} live rows", "build")
        m = self._manifest()
        segments = [self._image(latest(self.log(m)).where("op = 'write'"), graph)] if n else []
        m = self._commit(m, segments=segments, retired=m["retired"] + _paths(m["segments"]), history_from=m["watermark"], config=new.to_dict())
        self.config = new
        return {"version": m["version"], "durable_watermark": m["watermark"]}

    def segments(self) -> DataFrame:
        """(path, kind, rows) of the current version."""
        return self.spark.createDataFrame([(x["path"], x["kind"], x["rows"]) for x in self._manifest()["segments"]], "path string, kind string, rows long")

    def export(self, path: str) -> None:
        self.records().write.parquet(path)

    def batches(self, path: str, rows: int = 10_000) -> Iterator[pa.Table]:
        """The live rows (id, vector, version) of a sealed segment in order of id, at most so many at a time."""
        self._require()
        found = [x for x in self._manifest()["segments"] if x["path"] == path and x["kind"] == "sealed"]
        if not found:
            raise NotFound(f"no sealed segment {path!r}")
        live = self._read(found).where("op = 'write'").select("id", "vector", F.col("seq").alias("version"))
        held = []
        for r in live.orderBy("id").toLocalIterator():
            held.append((r.id, r.vector, r.version))
            if len(held) >= rows:
                yield _table(held)
                held = []
        if held:
            yield _table(held)

    def close(self) -> None:
        self.closed = True

    def __enter__(self) -> Collection:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def _table(rows: list[tuple]) -> pa.Table:
    ids, vectors, versions = zip(*rows, strict=True)
    return pa.table({"id": pa.array(ids), "vector": pa.array(vectors), "version": pa.array(versions, pa.int64())})


def _paths(segments: list[dict]) -> list[str]:
    return [x[k] for x in segments for k in ("path", "codes") if k in x]


__all__ = ["FAILED", "Collection", "Engine", "SearchResult", "connect"]
