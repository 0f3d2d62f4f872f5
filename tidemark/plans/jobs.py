"""Command-line jobs for spark-submit.

    python -m tidemark.plans.jobs profile issues=DIR pr_daily=DIR ... --out DIR
    python -m tidemark.plans.jobs build --issues DIR --pr DIR --push DIR --release DIR --watch DIR --out DIR
    python -m tidemark.plans.jobs verify --issues DIR --joined DIR --pr DIR --push DIR --release DIR --watch DIR --repo NAME --out DIR
    python -m tidemark.plans.jobs train --input DIR --out DIR [--signals] [--smoke] [--form one_vs_rest]
    python -m tidemark.plans.jobs train-sampled --input DIR --out DIR [--signals] [--smoke]
    python -m tidemark.plans.jobs train-incremental --input DIR --out DIR [--state DIR] [--signals] [--every N] [--patience N]
    python -m tidemark.plans.jobs score --input DIR --model DIR --out DIR

``train-incremental`` goes through the shards of --input in their order, one round each, from the state in --state if
given, and keeps the state that did best on a tenth of the rows, held out by row; later shards go on from --out/state.
``--smoke`` reads the first three shards, samples little, names its report apart and keeps no model.
``verify`` writes its tables and ends with an error if they show a lost row or a sum that differs from the daily rows
of the days before: activity of the record's own day in a sum, or a day too far back, is a leak.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark import fixed, session
from tidemark.functions.scalars import bucket_fraction
from tidemark.operators import quality, splits
from tidemark.operators.trailing import signal_feeds
from tidemark.plans import feature_table, incremental, report, sampled, training
from tidemark.sources import footers, shards, tables


def run_profile(spark: SparkSession, args: argparse.Namespace) -> None:
    named = dict(item.split("=", 1) for item in args.datasets)
    found = footers.file_profile(spark, named)
    found.coalesce(1).write.mode("overwrite").json(args.out)


def run_build(spark: SparkSession, args: argparse.Namespace) -> None:
    inputs = [shards.read_shards(spark, p) for p in (args.issues, args.pr, args.push, args.release, args.watch)]
    built = feature_table.build_checked(*inputs, path=args.out, dedupe_keys=not args.fan_out, max_records=args.max_records)
    for signal in built.alarms:
        print(f"{signal}: {built.zero_shares[signal]:.1%} of {built.joined_rows} rows are zero")


def run_verify(spark: SparkSession, args: argparse.Namespace) -> None:
    issues = shards.read_shards(spark, args.issues)
    joined = shards.with_row_id(shards.read_shards(spark, args.joined))
    checks = {
        "row_parity": quality.row_parity(issues, joined),
        "spot_check": quality.spot_check(
            joined,
            shards.read_shards(spark, args.pr),
            args.repo,
            "pr_merged_30d",
            "pr_merged_count",
            fixed.SHORT_WINDOW_DAYS,
            ["issue_created_at", "row_id"],
        ),
        "signal_zero_fraction": feature_table.zero_report(joined),
        "leakage": quality.leakage(joined, signal_feeds(*(shards.read_shards(spark, p) for p in (args.pr, args.push, args.release, args.watch)))),
    }
    for name, check in checks.items():
        check.coalesce(1).write.mode("overwrite").json(f"{args.out}/{name}")
    wrong = []
    parity = spark.read.json(f"{args.out}/row_parity").first()
    if parity.source_rows != parity.joined_rows:
        wrong.append(f"{parity.source_rows} issues, but {parity.joined_rows} joined rows")
    spots = spark.read.schema("stored bigint, counted_again bigint").json(f"{args.out}/spot_check")
    if bad := spots.where("not stored <=> counted_again").count():
        wrong.append(f"{bad} of the sums looked at differ from the daily rows")
    for line in spark.read.json(f"{args.out}/leakage").where("leaks > 0").collect():  # a line a signal at most
        wrong.append(f"{line.signal} has days outside its window in {line.leaks} rows")
    if wrong:
        raise SystemExit("; ".join(wrong))


def run_train(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = shards.read_smoke(spark, args.input) if args.smoke else shards.read_shards(spark, args.input)
    spec = training.LinearSpec(signals=args.signals, form=args.form, iterations=args.iterations)
    model = training.fit_linear(splits.train_rows(rows), spec)
    # Written once: the report reads the pairs, not the scoring plan.
    pairs = tables.materialize(model.predict(splits.test_rows(rows)), session.scratch_dir(spark, "pairs"))
    name = ("lr_text_signals" if args.signals else "lr_text") + ("_smoke" if args.smoke else "")
    counts = {"train": splits.train_rows(rows).count(), "test": pairs.count()}
    notes = report.header(counts, _CUTS, fixed.SIGNALS if args.signals else (), [f"{args.form}, {args.iterations} iterations"])
    report.write_report(spark, report.evaluate(pairs, name, notes), f"{args.out}/{name}_eval")
    if not args.smoke:
        model.save(f"{args.out}/{name}")


_CUTS = {"train before": fixed.TRAIN_END, "test before": fixed.TEST_END}


def run_train_sampled(spark: SparkSession, args: argparse.Namespace) -> None:
    read = shards.read_smoke if args.smoke else shards.read_shards
    rows = shards.with_row_id(read(spark, args.input))
    specs = [training.LinearSpec(signals=args.signals, l2=l2, iterations=args.iterations) for l2 in args.l2]
    target = fixed.SMOKE_SAMPLE_TARGET if args.smoke else fixed.SAMPLE_TARGET
    run = sampled.train_sampled(splits.train_rows(rows), splits.test_rows(rows), "row_id", specs, target)
    name = ("lr_sampled_signals" if args.signals else "lr_sampled") + ("_smoke" if args.smoke else "")
    tried = [f"{c.name}: l2 {c.model.spec.l2}, macro F1 {c.macro_f1:.4f}" for c in run.candidates]
    notes = report.header(run.counts(), _CUTS, fixed.SIGNALS if args.signals else (), tried)
    report.write_report(spark, report.evaluate(run.pairs, name, notes), f"{args.out}/{name}_eval")
    if not args.smoke:
        run.best.model.save(f"{args.out}/{name}")


def run_train_incremental(spark: SparkSession, args: argparse.Namespace) -> None:
    spec = incremental.SgdSpec(signals=args.signals)
    state = incremental.SgdState.load(spark, args.state) if args.state else incremental.SgdState.new(spec)
    held = bucket_fraction(F.col("row_id")) < 1 / fixed.HOLDOUT_DIVISOR
    own = [splits.train_rows(shards.with_row_id(shard)) for shard in shards.each_shard(spark, args.input)]
    val = splits.train_rows(shards.with_row_id(shards.read_shards(spark, args.input))).where(held)
    fit = incremental.fit_with_checkpoints(
        spark, state, [shard.where(~held) for shard in own], val, "row_id", f"{args.out}/checkpoints", args.every, args.patience
    )
    best = fit.model(spark)
    best.save(spark, f"{args.out}/state")
    pairs = incremental.predict(best, splits.test_rows(shards.read_shards(spark, args.input)))
    pairs = tables.materialize(pairs, session.scratch_dir(spark, "pairs"))
    tried = [f"round {c.round}: macro F1 {c.macro_f1:.4f}" for c in fit.history] + [f"kept: round {fit.best.round}"]
    notes = report.header({"train": sum(best.seen), "test": pairs.count()}, _CUTS, fixed.SIGNALS if best.spec.signals else (), tried)
    report.write_report(spark, report.evaluate(pairs, "incremental", notes), f"{args.out}/incremental_eval")


def run_score(spark: SparkSession, args: argparse.Namespace) -> None:
    """Test rows through a saved model: predictions as a table, and their report."""
    rows = shards.with_row_id(shards.read_shards(spark, args.input))
    model = training.load_model(spark, args.model)
    pairs = tables.materialize(model.predict_stored(splits.test_rows(rows), ["row_id"]), f"{args.out}/predictions")
    notes = report.header({"test": pairs.count()}, _CUTS, fixed.SIGNALS if model.spec.signals else ())
    report.write_report(spark, report.evaluate(pairs, "saved model", notes), f"{args.out}/report")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    jobs = top.add_subparsers(dest="job", required=True)

    job = jobs.add_parser("profile")
    job.add_argument("datasets", nargs="+", metavar="NAME=DIR")
    job.set_defaults(run=run_profile)

    job = jobs.add_parser("build")
    for table in ("issues", "pr", "push", "release", "watch"):
        job.add_argument(f"--{table}", required=True)
    job.add_argument("--fan-out", action="store_true", help="count a shared (repository, time) key once per issue")
    job.add_argument("--max-records", type=int, default=1_000_000)
    job.set_defaults(run=run_build)

    job = jobs.add_parser("verify")
    for value in ("issues", "joined", "pr", "push", "release", "watch", "repo"):
        job.add_argument(f"--{value}", required=True)
    job.set_defaults(run=run_verify)

    job = jobs.add_parser("train-sampled")
    job.add_argument("--input", required=True)
    job.add_argument("--signals", action="store_true")
    job.add_argument("--smoke", action="store_true")
    job.add_argument("--iterations", type=int, default=10)
    job.add_argument("--l2", type=float, nargs="+", default=[1e-4, 1e-2])
    job.set_defaults(run=run_train_sampled)

    job = jobs.add_parser("train-incremental")
    job.add_argument("--input", required=True)
    job.add_argument("--state")
    job.add_argument("--signals", action="store_true")
    job.add_argument("--every", type=int, default=1)
    job.add_argument("--patience", type=int, default=5)
    job.set_defaults(run=run_train_incremental)

    job = jobs.add_parser("score")
    job.add_argument("--input", required=True)
    job.add_argument("--model", required=True)
    job.set_defaults(run=run_score)

    job = jobs.add_parser("train")
    job.add_argument("--input", required=True)
    job.add_argument("--signals", action="store_true")
    job.add_argument("--smoke", action="store_true")
    job.add_argument("--form", choices=("softmax", "one_vs_rest"), default="softmax")
    job.add_argument("--iterations", type=int, default=10)
    job.set_defaults(run=run_train)

    for job in jobs.choices.values():
        job.add_argument("--out", required=True)
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = session.prepare(spark) if spark else session.build(f"tidemark-{args.job}")
    inputs = [getattr(args, n, None) for n in ("issues", "pr", "push", "release", "watch", "input", "joined")]
    session.size_shuffles(spark, [path for path in inputs if path])
    with session.run_folder(spark):
        args.run(spark, args)


if __name__ == "__main__":
    main()
