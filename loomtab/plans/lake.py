"""Bronze, silver, gold and platinum products: content-addressed, written to staging, committed by their manifest.

A product is a folder ``{layer}/{product_id}`` with its tables and ``manifest.json``, which is written last: without
it the folder doesn't count.  The paths are local or on a mounted shared folder.
"""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import asdict, dataclass
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import discard, tidy, written
from ..operators import splits as S
from ..operators.identity import differing_ranges, digest_leaves, frame_digest, merkle_nodes, row_id_parts, schema_string
from ..operators.profile import Contract, null_counts
from ..schema import col, free_name
from ..sources.tables import describe_parquet


#: Parts in which rows get their ids, so that no more than one is shuffled at a time.
PARTS = 4


class LakeError(RuntimeError):
    """A product that is broken, or differs from what was committed before."""


@dataclass(frozen=True)
class Product:
    layer: str
    product_id: str
    path: str
    manifest: dict

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """A table, or columns of a stored one; ``inline`` names an array of which each entry is a row."""
        ref = self.manifest["tables"].get(name, {})
        stored = spark.read.parquet(f"{self.path}/{ref.get('path', name)}")
        if "columns" not in ref:
            return stored
        return stored.select(*map(col, ref["columns"]), *([F.inline(col(ref["inline"]))] if "inline" in ref else []))


def _digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def _catalog_line(m: dict) -> str:
    one = {"product_id": m["product_id"], "layer": m["layer"], "row_count": sum(t["row_count"] for t in m["tables"].values()), "created_at": m["created_at"], "inputs": m["inputs"]}
    return json.dumps(one, sort_keys=True) + "\n"


class Lake:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, Path(root)

    def committed(self, layer: str, key: dict) -> Product | None:
        """The verified product of this key, if there is one."""
        product_id = f"{layer}-{_digest(key)[:24]}"
        return self.open(layer, product_id, verify=True) if (self.root / layer / product_id / "manifest.json").exists() else None

    def commit(
        self,
        layer: str,
        key: dict,
        tables: dict[str, DataFrame | Iterable[DataFrame]],
        inputs: list[str] = (),
        extra: dict | None = None,
        views: Callable[[DataFrame], dict[str, dict]] | None = None,
    ) -> Product:
        """Write the tables unless a product of this key is there: that one is verified and returned.

        A table may come in several frames, one written after the other.  ``views`` checks the stored table, if there is
        only one, and says which tables are read from it: their columns, rows and arrays to ``inline``.
        """
        if found := self.committed(layer, key):
            return found
        product_id = f"{layer}-{_digest(key)[:24]}"
        final = self.root / layer / product_id
        staging = self.root / layer / f".{product_id}-{uuid.uuid4().hex[:8]}"
        refs = {}
        for name, frames in tables.items():
            for df in [frames] if isinstance(frames, DataFrame) else frames:
                df.write.mode("append").parquet(str(staging / name), compression="zstd")
            stored = self.spark.read.parquet(str(staging / name))
            refs[name] = asdict(describe_parquet(self.spark, str(staging / name))) | {"path": name, "schema": schema_string(stored)}
            # the leaves of the rows' tree, by which a deep check names the part that has changed
            digest_leaves(stored).coalesce(1).write.parquet(str(staging / "trees" / name))
        if views:
            (name, ref), *_ = refs.items()
            try:
                found = views(self.spark.read.parquet(str(staging / name)))
            except Exception:
                shutil.rmtree(staging)
                raise
            product = Product(layer, product_id, str(staging), {"tables": {n: {"path": name} | v for n, v in found.items()}})
            refs = {n: ref | {"path": name, "schema": schema_string(product.table(self.spark, n))} | v for n, v in found.items()}
        manifest = {"layer": layer, "product_id": product_id, "key": key, "tables": refs, "inputs": list(inputs), "created_at": datetime.now(timezone.utc).isoformat(), **(extra or {})}
        staging.mkdir(parents=True, exist_ok=True)
        (staging / "manifest.json").write_text(json.dumps(manifest, sort_keys=True, indent=2, default=str))
        try:
            staging.rename(final)
        except OSError:  # another writer was first: its product must be the same
            shutil.rmtree(staging)
            return self.open(layer, product_id, verify=True)
        self.register(manifest)
        return Product(layer, product_id, str(final), manifest)

    def open(self, layer: str, product_id: str, verify: bool = False) -> Product:
        path = self.root / layer / product_id
        if path.resolve().parent != (self.root / layer).resolve() or not (path / "manifest.json").exists():
            raise LakeError(f"no product {layer}/{product_id}")
        manifest = json.loads((path / "manifest.json").read_text())
        if manifest["product_id"] != product_id:
            raise LakeError(f"{path} holds {manifest['product_id']}")
        product = Product(layer, product_id, str(path), manifest)
        if verify:
            self.verify(product)
        return product

    def verify(self, product: Product, deep: bool = False) -> None:
        """Every table's files have the size and digest of the manifest; ``deep``: or else which ranges of rows differ is told."""
        for name, ref in {ref["path"]: ref for ref in product.manifest["tables"].values()}.items():
            try:
                now = describe_parquet(self.spark, f"{product.path}/{name}")
            except Exception as e:
                raise LakeError(f"{product.product_id}/{name}: {e}") from e
            if (now.size, now.digest) != (ref["size"], ref["digest"]):
                parts = f" in {self._damage(product, name)}" if deep else ""
                raise LakeError(f"{product.product_id}/{name} has changed{parts}")
            if deep and (damage := self._damage(product, name)):
                raise LakeError(f"{product.product_id}/{name} has changed in {damage}")

    def _damage(self, product: Product, name: str) -> str:
        """The first ranges of row digests in which a table differs from its tree, with their rows then and now."""
        then, now = self.spark.read.parquet(f"{product.path}/trees/{name}"), digest_leaves(self.spark.read.parquet(f"{product.path}/{name}")).cache()
        found = differing_ranges(merkle_nodes(then), merkle_nodes(now)).orderBy("prefix").limit(6).collect()
        return ", ".join(f"{r.prefix} ({r.n_left} rows, now {r.n_right})" for r in found[:5]) + ("..." if len(found) > 5 else "")

    def bronze(self, df: DataFrame, source: dict) -> Product:
        """An immutable snapshot, keyed by content and source."""
        d = frame_digest(df).first()
        return self.commit("bronze", {"content": d.digest, "rows": d.n_rows, "source": source}, {"data": df}, extra={"schema_digest": _digest(schema_string(df))})

    def silver(self, bronze: Product, contract: Contract) -> Product:
        """The snapshot, if it keeps the contract, with its null counts."""
        df = bronze.table(self.spark, "data")
        contract.check(df)
        return self.commit("silver", {"input": bronze.product_id, "contract": asdict(contract)}, {"data": df, "quality": null_counts(df)}, [bronze.product_id])

    def gold(self, silver: Product, target: str, strategy: str | None = None, folds: int = 5, seed: int | None = None, column: str | None = None, gap: int = 0, embargo: int = 0) -> Product:
        """Features, labels and splits by row id.  Without a strategy: stratified up to 20 labels, else kfold.

        A row is stored once, with its id, its label and an array of its memberships; the three tables are read from that.
        """
        df = silver.table(self.spark, "data")
        if strategy is None:
            strategy = "stratified" if df.select(col(target)).distinct().limit(21).count() <= 20 else "kfold"
        key = {"input": silver.product_id, "target": target, "strategy": strategy, "folds": folds, "seed": seed, "column": column, "gap": gap, "embargo": embargo}
        if strategy not in ("kfold", "stratified", "time", "purged_time", "group"):
            raise S.SplitError(f"no strategy {strategy}")
        if strategy in ("time", "purged_time", "group") and not column:
            raise S.SplitError(f"{strategy} needs a column")
        if found := self.committed("gold", key):
            return found
        parts = [written(p, "zstd") for p in row_id_parts(df, PARTS)]
        try:
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionByName(p)
            name = free_name(rows, "splits")
            if strategy in ("kfold", "stratified"):
                own, add = free_name(rows, "_own"), S.fold_bounds(rows, folds, target if strategy == "stratified" else None, seed)
                with_splits = lambda p: add(p, own).withColumn(name, S.listed(F.col(own), folds)).drop(own)
            else:
                members = S.group_kfold(rows, column, folds) if strategy == "group" else S.time_split(rows, column, folds, gap, embargo if strategy == "purged_time" else 0)
                members = written(members, "zstd")
                parts.append(members)
                if strategy != "group":
                    S.validate_time_split(members, rows, column)
                # rows that are in no fold, as a gap leaves them, have an empty array
                each = members.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("fold", "role", "repeat"))).alias(name))
                none = F.array().cast("array<struct<fold: smallint, role: string, repeat: smallint>>")
                with_splits = lambda p: p.join(each, "row_id", "left").withColumn(name, F.coalesce(name, none))

            def dealt() -> Iterator[DataFrame]:
                for p in parts[:PARTS]:
                    yield with_splits(p)
                    discard(p)

            def views(stored: DataFrame) -> dict[str, dict]:
                n, m = S.validate_listed(stored, name)
                plain = [c for c in stored.columns if c not in (target, name)]
                return {"features": {"columns": plain, "row_count": n}, "labels": {"columns": ["row_id", target], "row_count": n}, "splits": {"columns": ["row_id"], "inline": name, "row_count": m}}

            return self.commit("gold", key, {"rows": dealt()}, [silver.product_id], {"strategy": strategy}, views)
        finally:
            for p in parts:
                discard(p)

    def platinum(self, gold: Product, metrics: dict) -> Product:
        table = self.spark.createDataFrame([(k, float(v)) for k, v in sorted(metrics.items())], "metric string, value double")
        return self.commit("platinum", {"input": gold.product_id, "metrics": metrics}, {"metrics": table}, [gold.product_id])

    def manifests(self) -> list[dict]:
        return [json.loads(p.read_text()) for p in sorted(self.root.glob("*/*/manifest.json")) if not p.parent.name.startswith(".")]

    @property
    def catalog_file(self) -> Path:
        return self.root / "catalog.jsonl"

    def register(self, manifest: dict) -> None:
        """Add a product to the catalog, which lasts beyond the session; a product that is there twice counts once."""
        self.catalog_file.parent.mkdir(parents=True, exist_ok=True)
        with self.catalog_file.open("a") as f:
            f.write(_catalog_line(manifest))
            f.flush()
            os.fsync(f.fileno())

    def rebuild_catalog(self) -> int:
        """Make the catalog anew from the committed manifests, in one step; the number of products."""
        found = self.manifests()
        self.root.mkdir(parents=True, exist_ok=True)
        staging = self.root / f".catalog-{uuid.uuid4().hex[:8]}.jsonl"
        staging.write_text("".join(map(_catalog_line, found)))
        staging.replace(self.catalog_file)
        return len(found)

    def products(self, layer: str | None = None, limit: int = 100) -> list[dict]:
        """The newest products first, at most ``limit``: product_id, layer, row_count, created_at, inputs."""
        lines = self.catalog_file.read_text().splitlines() if self.catalog_file.exists() else []
        found = {}
        for line in lines:
            try:
                one = json.loads(line)
            except ValueError:  # a torn line: the manifest is there, and rebuild_catalog finds it
                continue
            found[one["product_id"]] = one
        kept = [p for p in found.values() if layer in (None, p["layer"])]
        return sorted(kept, key=lambda p: (p["created_at"], p["product_id"]), reverse=True)[:limit]

    def catalog(self) -> None:
        """Temp views ``products`` and ``lineage`` over the catalog."""
        found = self.products(limit=2**31)
        products = [(p["product_id"], p["layer"], p["row_count"], p["created_at"]) for p in found]
        edges = [(u, p["product_id"]) for p in found for u in p["inputs"]]
        self.spark.createDataFrame(products, "product_id string, layer string, row_count long, created_at string").createOrReplaceTempView("products")
        self.spark.createDataFrame(edges, "upstream string, downstream string").createOrReplaceTempView("lineage")

    def collect_garbage(self, dry_run: bool = True) -> list[str]:
        """Staging folders that no commit finished."""
        left = sorted(str(p) for p in self.root.glob("*/.*") if p.is_dir())
        if not dry_run:
            for p in left:
                shutil.rmtree(p)
        return left


_WRITERS = ("Insert", "Create", "Replace", "Drop", "Delete", "Update", "Merge", "Command", "Alter", "Truncate", "Overwrite", "Append", "Cache", "Call", "Load", "Set")


def _writes(plan) -> str | None:
    """The name of a node that writes or commands, anywhere in a parsed plan."""
    open_ = [plan]
    while open_:
        node = open_.pop()
        name = node.getClass().getSimpleName()
        if any(w in name for w in _WRITERS) and name not in ("SetOperation",):
            return name
        for part in (node.children(), node.innerChildren()):
            open_ += [part.apply(i) for i in range(part.size())]
    return None


def catalog_query(spark: SparkSession, query: str) -> DataFrame:
    """One SELECT, WITH or EXPLAIN over the catalog views; anything else, or more, is an error."""
    from ..sources.tables import DataLoadError

    body = query.strip().rstrip(";").strip()
    if ";" in body or body.split(None, 1)[0].lower() not in ("select", "with", "explain", "values"):
        raise DataLoadError("only a single query is allowed")
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(body)
    if body.split(None, 1)[0].lower() != "explain" and (found := _writes(plan)):
        raise DataLoadError(f"only a query is allowed, not {found}")
    return spark.sql(body)


def lineage_closure(edges: DataFrame, product: str, rounds: int = 50) -> DataFrame:
    """(product_id) of everything that ``product`` was made from, in steps of one edge; cycles end, over ``rounds`` steps are an error."""
    edges = edges.select("upstream", "downstream").distinct().cache()
    new = edges.where(F.col("downstream") == product).select(F.col("upstream").alias("product_id")).distinct().cache()
    seen = new
    for _ in range(rounds):
        if new.isEmpty():
            return seen
        above = edges.join(new, edges.downstream == new.product_id).select(F.col("upstream").alias("product_id")).distinct()
        new = above.join(seen, "product_id", "left_anti").cache()
        seen = seen.unionByName(new)
    raise ValueError(f"more than {rounds} steps above {product}")


def quality_json(product: Product, spark: SparkSession) -> str:
    return json.dumps({r.column: r.n_null for r in product.table(spark, "quality").collect()}, sort_keys=True)


def run_key(plan: dict) -> str:
    """The digest that finds an earlier run of an equal plan."""
    return _digest(plan)


def medallion_run(spark: SparkSession, root: str, df: DataFrame, target: str, task: str, contract: Contract | None = None, **split) -> dict:
    """Bronze to platinum with a linear baseline scored on the stored folds; reused where nothing changed."""
    from ..operators.models import cross_validate, make_model
    from ..operators.prep import fit_prep
    from ..schema import numeric_columns

    lake = Lake(spark, root)
    with tidy(spark):
        bronze = lake.bronze(df, {"target": target})
        silver = lake.silver(bronze, contract or Contract())
        gold = lake.gold(silver, target, **split)
        name = gold.manifest["tables"]["splits"].get("inline")
        if name:
            rows, members = gold.table(spark, "rows"), name
        else:  # a product of three stored tables
            rows, members = gold.table(spark, "features").join(gold.table(spark, "labels"), "row_id"), gold.table(spark, "splits")
        prepared = fit_prep(rows.drop("row_id", name or ""), target).transform(rows)
        features = [c for c in numeric_columns(prepared) if c != target]
        metric = "r2" if task == "regression" else "roc_auc"
        # one fold after the other: each holds its training rows in memory, or else on disk
        scores = cross_validate(prepared, features, target, make_model("linear", task), [metric], membership=members, workers=1)
        platinum = lake.platinum(gold, {metric: round(scores[metric][0], 6)})
    return {"bronze": bronze.product_id, "silver": silver.product_id, "gold": gold.product_id, "platinum": platinum.product_id, metric: scores[metric][0]}
