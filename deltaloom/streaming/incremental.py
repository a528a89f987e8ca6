"""Incremental composition: changes of the primary and of related tables in, documents and tombstones out.

The state is four kinds of bucketed tables (``store``): rows of every table by primary key; related rows by join key;
primary keys by foreign key, one table a relation. A micro-batch folds its changes by key, finds the old image of each
changed row, and so the old and new join keys; looks up the primaries that refer to these; and composes their documents
from the related rows that they refer to. It reads and rewrites the buckets of these keys only, so its cost follows the
changes and the size of a bucket, not the tables. A truncate is the exception: it touches all that its table had.

Order of durability: state and output of a batch, then its manifest, then the source's offsets. A batch that is run
again writes the same state and output again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import doc_id
from ..operators.changelog import after_truncate, last_writer
from ..operators.compose import Join, compose, documents_json
from .store import Store


class Composer:
    """``schemas`` and ``keys``: DDL and primary key of every table of the join. Changes: (table, op, version, row), op one
    of insert, update, delete, truncate; row is JSON text, of a delete at least its key."""

    def __init__(self, spark: SparkSession, join: Join, schemas: dict[str, str], keys: dict[str, list[str]], root: str, buckets: int = 64):
        self.spark, self.join, self.schemas, self.keys = spark, join, schemas, keys
        self.store = Store(spark, root, buckets)
        self.related = {r.table: r for r in join.relations}
        self.out_schema = "doc_id string, op string, doc string"

    def _table(self, m: dict, table: str, buckets: list[int] | None = None) -> DataFrame:
        return self.store.read(m, f"rows-{table}", self.schemas[table], buckets)

    @staticmethod
    def _texts(df: DataFrame, columns: list[str], *more: str) -> DataFrame:
        """Join keys as text, _j0 and on; rows with a null in them have none."""
        return df.select(*[F.col(c).cast("string").alias(f"_j{i}") for i, c in enumerate(columns)], *more).dropna(subset=[f"_j{i}" for i in range(len(columns))])

    def _replaced(self, m: dict, name: str, schema: str, by: list[str], old: DataFrame, new: DataFrame, batch: int) -> None:
        """Rows ``old`` go from a bucketed table, rows ``new`` come."""
        where = self.store.touched(old.select(*by).unionByName(new.select(*by)), *by)
        have = self.store.read(m, name, schema, where)
        same = reduce(lambda a, b: a & b, [have[c].eqNullSafe(old[c]) for c in have.columns])
        self.store.write(m, name, have.join(old, same, "left_anti").unionByName(new), where, batch, *by)

    def batch(self, changes: DataFrame, n: int) -> DataFrame:
        """Applies batch ``n`` to the state and returns its output: (doc_id, op, doc), op upsert or delete."""
        m = self.store.manifest(n)
        changes = changes.persist()
        try:
            return self._batch(changes, n, m)
        finally:
            changes.unpersist()

    def _batch(self, changes: DataFrame, n: int, m: dict) -> DataFrame:
        store, join = self.store, self.join
        present = {r[0] for r in changes.select("table").distinct().collect()}
        cut = {r[0] for r in changes.where("op = 'truncate'").select("table").distinct().collect()}
        later = after_truncate(changes, "table", "version")
        touched_keys, foreign = [], {i: [] for i in range(len(join.relations))}
        for table in self.schemas:
            if table not in present:
                continue
            key, schema = self.keys[table], self.schemas[table]
            own = later.where(F.col("table") == table).select("op", "version", F.from_json("row", schema).alias("r")).select("op", "version", "r.*")
            last = self._kept(last_writer(own.withColumn("_n", F.lit(0)), key, "version", "_n").drop("_n", "version"), f"last-{table}", n)
            where = list(range(store.buckets)) if table in cut else store.touched(last, *key)
            have = self._table(m, table, where)
            old = have if table in cut else have.join(last.select(*key), key, "left_semi")
            old = self._kept(old.select(*have.columns), f"old-{table}", n)
            new = last.where("op <> 'delete'").select(*have.columns)
            kept = have.limit(0) if table in cut else have.join(last.select(*key), key, "left_anti").select(*have.columns)
            store.write(m, f"rows-{table}", kept.unionByName(new), where, n, *key)
            for i, rel in enumerate(join.relations):
                fk, rk = [p for p, _ in rel.on], [r for _, r in rel.on]
                names = [f"_j{x}" for x in range(len(rk))]
                if rel.table == table:
                    both = self._texts(old, rk).unionByName(self._texts(new, rk)).distinct()
                    foreign[i].append(self._kept(both, f"moved-{i}-{table}", n))
                    self._replaced(m, f"related-{i}", f"{', '.join(f'{x} string' for x in names)}, {schema}", names, self._texts(old, rk, *have.columns), self._texts(new, rk, *have.columns), n)
                if table == join.primary:
                    self._replaced(m, f"refers-{i}", self._refers(i), names, self._texts(old, fk, *key), self._texts(new, fk, *key), n)
            if table == join.primary:
                touched_keys += [last.select(*key), old.select(*key)]
        for i in range(len(join.relations)):
            for moved in foreign[i]:
                names = moved.columns
                refers = store.read(m, f"refers-{i}", self._refers(i), store.touched(moved, *names))
                touched_keys.append(refers.join(moved, names, "left_semi").select(*join.key))
        keys = self._kept(reduce(DataFrame.unionByName, touched_keys).distinct(), "keys", n) if touched_keys else None
        out = self._documents(m, keys, n) if keys is not None else self.spark.createDataFrame([], self.out_schema)
        out = self._kept(out, "output", n)
        store.commit(m, n)
        return out

    def _refers(self, i: int) -> str:
        types = {f.name: f.dataType.simpleString() for f in self.spark.createDataFrame([], self.schemas[self.join.primary]).schema}
        return ", ".join([*(f"_j{x} string" for x in range(len(self.join.relations[i].on))), *(f"{k} {types[k]}" for k in self.join.key)])

    def _documents(self, m: dict, keys: DataFrame, n: int) -> DataFrame:
        join, store = self.join, self.store
        primary = self._table(m, join.primary, store.touched(keys, *join.key)).join(keys, list(join.key), "left_semi")
        primary = self._kept(primary, "primaries", n)
        # A relation's rows are those that the primaries refer to, under a name of its own: two relations may share a table.
        tables, rels = {join.primary: primary}, []
        for i, rel in enumerate(join.relations):
            wanted = self._texts(primary, [p for p, _ in rel.on]).distinct()
            schema = f"{', '.join(f'_j{x} string' for x in range(len(rel.on)))}, {self.schemas[rel.table]}"
            rows = store.read(m, f"related-{i}", schema, store.touched(wanted, *wanted.columns)).join(wanted, wanted.columns, "left_semi")
            tables[f"{i}:{rel.table}"] = rows.drop(*wanted.columns)
            rels.append(type(rel)(**(rel.__dict__ | {"table": f"{i}:{rel.table}"})))
        only = type(join)(join.primary, join.key, tuple(rels), join.select, join.target, join.name)
        docs = documents_json(compose(only, tables), only).select("doc_id", F.lit("upsert").alias("op"), "doc")
        gone = keys.join(primary.select(*join.key), list(join.key), "left_anti")
        return docs.unionByName(gone.select(doc_id(join.primary, *[F.col(k) for k in join.key]).alias("doc_id"), F.lit("delete").alias("op"), F.lit(None).cast("string").alias("doc")))

    def _kept(self, df: DataFrame, name: str, n: int) -> DataFrame:
        """Written beside the state, so that later steps of the batch do not read what they overwrite; kept for a batch."""
        path = f"{self.store.root}/batch/{n}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def run(self, stream: DataFrame, checkpoint: str, sink):
        """``sink(output, batch)`` gets each batch's output; it may be called again with the same batch after a failure."""

        def one(changes: DataFrame, n: int) -> None:
            sink(self.batch(changes, n), n)
            self.store.fs.delete(self.store._path(f"{self.store.root}/batch/{n - 1}"), True)

        return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
