"""Collections by name, with aliases and snapshots, kept as Parquet tables beside a description."""

from __future__ import annotations

import json
from dataclasses import asdict

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..collection import Collection, Dense, Sparse
from ..functions.text import TextIndex


def _describe(c: Collection) -> str:
    index = {k: {"text": {**asdict(v), "stopwords": sorted(v.stopwords)}} if isinstance(v, TextIndex) else v for k, v in c.index.items()}
    return json.dumps({"id": c.id, "vectors": {k: asdict(v) for k, v in c.vectors.items()}, "sparse": {k: asdict(v) for k, v in c.sparse.items()}, "payload": c.payload, "fields": c.fields, "index": index, "shard_key": c.shard_key})


def _restore(text: str) -> dict:
    d = json.loads(text)
    index = {k: TextIndex(**{**v["text"], "stopwords": frozenset(v["text"]["stopwords"])}) if isinstance(v, dict) else v for k, v in d["index"].items()}
    return {"id": d["id"], "vectors": {k: Dense(**v) for k, v in d["vectors"].items()}, "sparse": {k: Sparse(**v) for k, v in d["sparse"].items()}, "payload": d["payload"], "fields": d["fields"], "index": index, "shard_key": d.get("shard_key")}


class Catalog:
    """Collections under a folder of any file system that Spark can write to. Each write makes a new version of a table, then points to it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())
        #: Kept in the folder, so that every session knows them.
        self.aliases: dict[str, str] = json.loads(self._read("aliases.json")) if self._fs.exists(self._path("aliases.json")) else {}

    def _path(self, *parts: str):
        return self._fs_path("/".join([self.folder, *parts]))

    def _name(self, name: str) -> str:
        return self.aliases.get(name, name)

    def names(self) -> list[str]:
        root = self._path("collections")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(root)) if self._fs.exists(root) else []

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path("collections", self._name(name), "current"))

    def _read(self, *parts: str) -> str:
        return "\n".join(r[0] for r in self.spark.read.text("/".join([self.folder, *parts])).collect())

    def _write(self, text: str, *parts: str) -> None:
        out = self._fs.create(self._path(*parts), True)
        out.write(bytearray(text.encode()))
        out.close()

    def create(self, name: str, c: Collection) -> None:
        if self.exists(name) or name in self.aliases:
            raise ValueError(f"a collection or an alias {name!r} exists")
        self.save(name, c)

    def save(self, name: str, c: Collection) -> None:
        """Writes a new version; readers of the one before aren't disturbed."""
        name = self._name(name)
        version = int(self._read("collections", name, "current")) + 1 if self.exists(name) else 1
        c.df.write.parquet(f"{self.folder}/collections/{name}/v{version}")
        self._write(_describe(c), "collections", name, f"v{version}.json")
        self._write(str(version), "collections", name, "current")
        # The version before may still be read; older ones go.
        for old in (f"v{version - 2}", f"v{version - 2}.json"):
            self._fs.delete(self._path("collections", name, old), True)

    def get(self, name: str) -> Collection:
        name = self._name(name)
        if not self.exists(name):
            raise ValueError(f"no collection {name!r}")
        version = self._read("collections", name, "current").strip()
        return Collection(self.spark.read.parquet(f"{self.folder}/collections/{name}/v{version}"), **_restore(self._read("collections", name, f"v{version}.json")))

    def delete(self, name: str) -> bool:
        self._set_aliases({a: n for a, n in self.aliases.items() if n != name})
        return self._fs.delete(self._path("collections", name), True)

    def update_aliases(self, actions: list[dict]) -> None:
        """Creates, deletes and renames aliases, all or none."""
        new = dict(self.aliases)
        for a in actions:
            if "create" in a:
                if not self.exists(a["create"]["collection"]):
                    raise ValueError(f"no collection {a['create']['collection']!r}")
                if self._fs.exists(self._path("collections", a["create"]["alias"])):
                    raise ValueError(f"a collection {a['create']['alias']!r} exists")
                new[a["create"]["alias"]] = a["create"]["collection"]
            elif "delete" in a:
                new.pop(a["delete"]["alias"], None)
            elif a["rename"]["old"] in new:
                new[a["rename"]["new"]] = new.pop(a["rename"]["old"])
            else:
                raise ValueError(f"no alias {a['rename']['old']!r}")
        self._set_aliases(new)

    def _set_aliases(self, new: dict[str, str]) -> None:
        if new != self.aliases:
            self._write(json.dumps(new), "aliases.json")
            self.aliases = new

    def snapshot(self, name: str, label: str) -> str:
        """Writes a copy of a collection as it is."""
        c = self.get(name)
        c.df.write.parquet(f"{self.folder}/snapshots/{self._name(name)}/{label}")
        self._write(_describe(c), "snapshots", self._name(name), f"{label}.json")
        return label

    def snapshots(self, name: str) -> list[str]:
        root = self._path("snapshots", self._name(name))
        return sorted(s.getPath().getName() for s in self._fs.listStatus(root) if s.isDirectory()) if self._fs.exists(root) else []

    def recover(self, name: str, label: str) -> Collection:
        """Makes a snapshot the collection's newest version."""
        where = self._name(name)
        c = Collection(self.spark.read.parquet(f"{self.folder}/snapshots/{where}/{label}"), **_restore(self._read("snapshots", where, f"{label}.json")))
        self.save(where, c)
        return self.get(where)

    def delete_snapshot(self, name: str, label: str) -> None:
        self._fs.delete(self._path("snapshots", self._name(name), label), True)
        self._fs.delete(self._path("snapshots", self._name(name), f"{label}.json"), False)


def newest_versions(df, key: str = "id", version: str = "version"):
    """One row of each key, of its highest version."""
    rest = [n for n in df.columns if n != key]
    row = F.max_by(F.struct(*rest), F.coalesce(F.col(version).cast("long"), F.lit(-(2**63))))
    return df.groupBy(key).agg(row.alias("_row")).select(key, "_row.*")
