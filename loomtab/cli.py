"""Command line: ``python -m loomtab.cli <command>``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .operators.search import SPACES, hash_sample, importances, search, successive_halving
from .session import ExperimentConfig, ExperimentSession


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="loomtab")
    p.add_argument("--workspace", default=".loomtab")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run")
    check = sub.add_parser("check")
    hpo = sub.add_parser("hpo")
    medallion = sub.add_parser("medallion")
    for s in (run, check, hpo, medallion):
        s.add_argument("--data", required=True)
        s.add_argument("--target", required=True)
        s.add_argument("--task", default="classification")
        s.add_argument("--folds", type=int, default=5)
    run.add_argument("--models", nargs="*", default=[])
    run.add_argument("--quick", action="store_true", help="run on a fifth of the rows")
    run.add_argument("--resume", action="store_true", help="go on with an equal run")
    run.add_argument("--strategy", default="none", choices=["none", "afe", "embedding"])
    run.add_argument("--split", default="hash", choices=["hash", "kfold", "stratified", "group", "time"])
    run.add_argument("--column", help="column of a group or time split")
    run.add_argument("--calibration", choices=["platt", "isotonic"])
    plan = sub.add_parser("plan")
    ingest = sub.add_parser("ingest")
    for s in (plan, ingest):
        s.add_argument("--data", required=True)
    plan.add_argument("--target", required=True)
    plan.add_argument("--task", default="classification")
    sub.add_parser("registry")
    export = sub.add_parser("export")
    export.add_argument("key")
    export.add_argument("path")
    predict = sub.add_parser("predict")
    predict.add_argument("--bundle", required=True)
    predict.add_argument("--data", required=True)
    predict.add_argument("--out", required=True)
    verify = sub.add_parser("verify")
    verify.add_argument("layer")
    verify.add_argument("product")
    verify.add_argument("--deep", action="store_true", help="compare the rows, and name the ranges that differ")
    lineage = sub.add_parser("lineage")
    lineage.add_argument("product")
    hpo.add_argument("--model", default="gbt")
    hpo.add_argument("--trials", type=int, default=10)
    hpo.add_argument("--sampler", default="tpe", choices=["tpe", "random"])
    hpo.add_argument("--halving", action="store_true", help="try on growing samples, the best on all rows")
    drift = sub.add_parser("drift")
    drift.add_argument("--reference", required=True)
    drift.add_argument("--new", required=True)
    drift.add_argument("--method", default="ks", choices=["ks", "psi", "domain_classifier", "both"])
    board = sub.add_parser("leaderboard")
    board.add_argument("--limit", type=int, default=20)
    diff = sub.add_parser("diff")
    diff.add_argument("a")
    diff.add_argument("b")
    sub.add_parser("state")
    catalog = sub.add_parser("catalog")
    catalog.add_argument("query", nargs="?", help="a SELECT over products and lineage; without one, the newest products")
    catalog.add_argument("--limit", type=int, default=100)
    catalog.add_argument("--rebuild", action="store_true", help="make the catalog anew from the committed manifests")
    init = sub.add_parser("init")
    init.add_argument("--force-reset-registry", action="store_true")
    docs = sub.add_parser("docs")
    docs.add_argument("--out", help="folder of the published documents; else below the workspace")
    docs.add_argument("--limit", type=int, default=100)
    gc = sub.add_parser("gc")
    gc.add_argument("--delete", action="store_true")
    a = p.parse_args(argv)

    from .plans import lake, reporting

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session = ExperimentSession(spark, a.workspace)
    if a.command == "run":
        config = ExperimentConfig(a.target, a.task, models=tuple(a.models), folds=a.folds, strategy=a.strategy, split=a.split, column=a.column, calibration=a.calibration, share=0.2 if a.quick else 1.0, resume=a.resume)
        session.run(config, session.load(a.data)).show(truncate=False)
    elif a.command == "plan":
        print(json.dumps(session.plan(ExperimentConfig(a.target, a.task), session.load(a.data)), default=lambda o: o.__dict__, sort_keys=True))
    elif a.command == "ingest":
        print(lake.Lake(spark, f"{a.workspace}/lake").bronze(session.load(a.data), {"path": a.data}).product_id)
    elif a.command == "registry":
        print(json.dumps(session.registry.load(), sort_keys=True, indent=2))
    elif a.command == "export":
        print(session.export(a.key, a.path))
    elif a.command == "predict":
        session.predictor(a.bundle)(session.load(a.data)).drop("probability").write.mode("errorifexists").parquet(a.out)
    elif a.command == "verify":
        store = lake.Lake(spark, f"{a.workspace}/lake")
        store.verify(store.open(a.layer, a.product), a.deep)
        print("as committed")
    elif a.command == "lineage":
        lake.Lake(spark, f"{a.workspace}/lake").catalog()
        for r in sorted(lake.lineage_closure(spark.table("lineage"), a.product).collect()):
            print(r.product_id)
    elif a.command == "check":
        issues = session.plan(ExperimentConfig(a.target, a.task, folds=a.folds), session.load(a.data))["issues"]
        for i in issues:
            print(i.severity, i.code, i.column or "", i.message)
        return int(any(i.severity == "error" for i in issues))
    elif a.command == "hpo":
        from .operators.models import cross_validate, make_model
        from .operators.prep import fit_prep
        from .schema import numeric_columns

        df = session.load(a.data)
        df = df.cache()
        features = [c for c in numeric_columns(fit_prep(df, a.target).transform(df)) if c != a.target]
        metric = "r2" if a.task == "regression" else "roc_auc"
        # fitted on each fold's training rows, so that no trial sees its validation rows
        prepare = lambda train: fit_prep(train.drop("_fold"), a.target).transform
        score = lambda rows, s: cross_validate(rows, features, a.target, make_model(a.model, a.task, **s), [metric], a.folds, prepare=prepare)[metric][0]
        if a.halving:
            best, rungs = successive_halving(lambda s, share: score(hash_sample(df, share), s), SPACES[a.model], metric, a.trials)
            trials = [t for rung in rungs for t in rung]
        else:
            best, trials = search(lambda s: score(df, s), SPACES[a.model], metric, a.trials, sampler=a.sampler)
        print(json.dumps({"best": best.settings, metric: best.score, "importances": importances(trials, metric, SPACES[a.model], even=True)}))
    elif a.command == "drift":
        print(json.dumps(session.drift_check(session.load(a.reference), session.load(a.new), a.method), default=lambda o: o.__dict__))
    elif a.command == "leaderboard":
        session.leaderboard(a.limit).show(truncate=False)
    elif a.command == "diff":
        reporting.run_diff(reporting.dedupe_events(session.events()), a.a, a.b).show(truncate=False)
    elif a.command == "state":
        print(session.state())
    elif a.command == "medallion":
        print(json.dumps(session.medallion_run(session.load(a.data), a.target, a.task, folds=a.folds)))
    elif a.command == "catalog":
        store = lake.Lake(spark, f"{a.workspace}/lake")
        if a.rebuild:
            print(store.rebuild_catalog())
        elif not a.query:
            print("\n".join(json.dumps(p, sort_keys=True) for p in store.products(limit=a.limit)))
        else:
            store.catalog()
            for line in lake.catalog_query(spark, a.query).limit(a.limit).toJSON().collect():
                print(line)
    elif a.command == "init":
        print(session.init(a.force_reset_registry))
    elif a.command == "docs":
        print(session.publish(a.out, a.limit))
    elif a.command == "gc":
        print("\n".join(lake.Lake(spark, f"{a.workspace}/lake").collect_garbage(not a.delete)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
