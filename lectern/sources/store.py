"""The durable library: documents, chunks with their tokens and vectors, the original files, and a manifest, as Parquet in a shared folder."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of doc_id by hash: what a change rewrites is the buckets that it touches.
VERSION, BUCKETS = 3, 64
DOCUMENTS = "doc_id string, title string, filename string, n_pages int, n_chunks int, added_at timestamp"
CHUNKS = "chunk_id int, text string, word_count int, page_start int, page_end int, section string, tokens array<string>, embedding array<double>, doc_id string"
ORIGINALS = "doc_id string, path string, content binary"
TABLES = {"documents": DOCUMENTS, "chunks": CHUNKS, "originals": ORIGINALS}


def bucket(buckets: int = BUCKETS):
    return F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")


class Library:
    """A library in ``folder``. A change writes the buckets of papers that it touches anew, as a new generation beside the old, and then the
    manifest of that generation, which names the generation of every bucket: a reader never sees half a change, a lost job leaves
    the library as it was, and of two writers at once the second fails. No manifest is an empty library.

    Chunks keep their tokens, so the lexical index is stored with them and grows and shrinks as they do."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self) -> dict:
        """{version, generation, dim, live: {bucket: generation}} of the latest generation."""
        path, fs = self._path("manifest")
        names = sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []
        names = [n for n in names if n.endswith(".json") and not n.startswith((".", "_"))]
        if not names:
            return {"version": VERSION, "generation": 0, "dim": None, "live": {}}
        m = json.loads(self.spark.read.text(f"{self.folder}/manifest/{names[-1]}", wholetext=True).first().value)
        if m["version"] != VERSION:
            raise ValueError(f"library has version {m['version']}, not {VERSION}")
        return m

    def _commit(self, m: dict) -> None:
        path, fs = self._path(f"manifest/{m['generation']:012d}.json")
        try:
            out = fs.create(path, False)
        except Exception as e:
            raise ValueError("the library was changed by another writer") from e
        out.write(json.dumps(m).encode())
        out.close()

    def _read(self, name: str, m: dict, only: list[int] | None = None) -> DataFrame:
        there = [f"g{g}/{name}/bucket={b}" for b, g in m["live"].items() if only is None or int(b) in only]
        paths = []
        for p in there:  # a bucket without rows of a table has no folder
            path, fs = self._path(p)
            if fs.exists(path):
                paths.append(f"{self.folder}/{p}")
        return self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])

    def load(self) -> tuple[DataFrame, DataFrame]:
        """(documents, chunks)."""
        m = self._manifest()
        return self._read("documents", m), self._read("chunks", m)

    def originals(self) -> DataFrame:
        """(doc_id, path, content) of the files that were kept."""
        return self._read("originals", self._manifest())

    def _write(self, tables: dict[str, DataFrame], m: dict, touched: list[int]) -> None:
        """A new generation in which the ``touched`` buckets hold just these rows. The number of chunks must be that of the
        documents, no id may stand twice, and all vectors must be of the library's length."""
        generation = m["generation"] + 1
        for name, rows in tables.items():
            kind = self.spark.createDataFrame([], TABLES[name]).schema
            rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind]).withColumn("bucket", bucket())
            # spread and sorted by paper: a paper's chunks lie together in a row group, and a scope prunes by its statistics
            order = ["bucket", "doc_id", "chunk_id"] if name == "chunks" else ["bucket", "doc_id"]
            rows.repartition("bucket", "doc_id").sortWithinPartitions(*order).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/g{generation}/{name}")
        live = {**m["live"], **{str(b): generation for b in touched}}
        new = {"version": VERSION, "generation": generation, "dim": m["dim"], "live": live}
        kept, have = self._read("documents", new, touched), self._read("chunks", new, touched)
        counts = kept.agg(F.sum("n_chunks").alias("n"), F.count(F.lit(1)).alias("d"), F.countDistinct("doc_id").alias("u")).first()
        sizes = have.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("embedding")).alias("a"), F.max(F.size("embedding")).alias("b")).first()
        if counts.d != counts.u:
            raise ValueError("a document id occurs twice")
        if (counts.n or 0) != sizes.n or sizes.a != sizes.b or None not in (m["dim"], sizes.a) and m["dim"] != sizes.a:
            raise ValueError(f"{counts.n or 0} chunks expected, {sizes.n} found, vectors of {sizes.a} to {sizes.b} numbers, of the library {m['dim']}")
        new["dim"] = sizes.a if sizes.a is not None else m["dim"]
        self._commit(new)

    def save(self, documents: DataFrame, chunks: DataFrame, originals: DataFrame | None = None) -> None:
        """Replaces the contents."""
        tables = {"documents": documents, "chunks": chunks, **({"originals": originals} if originals is not None else {})}
        self._write(tables, {**self._manifest(), "dim": None, "live": {}}, list(range(BUCKETS)))

    def _buckets(self, documents: DataFrame) -> list[int]:
        return sorted(r.b for r in documents.select(bucket().alias("b")).distinct().collect())

    def add(self, documents: DataFrame, chunks: DataFrame, originals: DataFrame | None = None) -> None:
        """Appends documents, with their files if ``originals`` has them. An id that is there already is an error, as is a document without chunks."""
        m, touched = self._manifest(), self._buckets(documents)
        old = {name: self._read(name, m, touched) for name in TABLES}
        twice = documents.join(old["documents"].select("doc_id"), "doc_id", "left_semi").first()
        if twice is not None:
            raise ValueError(f"document {twice.doc_id} is in the library already")
        if documents.join(chunks.select("doc_id"), "doc_id", "left_anti").first() is not None:
            raise ValueError("no text could be extracted from a document")
        new = {"documents": documents, "chunks": chunks, "originals": originals}
        self._write({n: old[n].unionByName(x.select(*[c for c in old[n].columns if c in x.columns]), allowMissingColumns=True) if x is not None else old[n] for n, x in new.items()}, m, touched)

    def remove(self, *doc_ids: str) -> bool:
        """Drops documents, their chunks and files; False if none of them is known."""
        m = self._manifest()
        gone = self.spark.createDataFrame([(d,) for d in doc_ids], "doc_id string")
        touched = self._buckets(gone)
        old = {name: self._read(name, m, touched) for name in TABLES}
        if old["documents"].join(gone, "doc_id", "left_semi").isEmpty():
            return False
        self._write({n: x.join(gone, "doc_id", "left_anti") for n, x in old.items()}, m, touched)
        return True

    def titles(self) -> DataFrame:
        return self.load()[0].select("doc_id", "title")
