"""Command line: run a pipeline file, export recordings as bundles, merge training sets."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence

from loomtide.plans.stages import Orchestrator, load_config
from loomtide.session import session
from loomtide.sinks.training_set import merge_training_sets
from loomtide.sources import discovery


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomtide", description=__doc__)
    p.add_argument("--master", help="Spark master; the environment's by default")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="run a pipeline file over inputs")
    run.add_argument("--config", required=True)
    run.add_argument("--jobs", type=int, help="inputs at once; the config's number by default")
    run.add_argument("inputs", nargs="*")
    export = sub.add_parser("export", help="write recordings as bundles")
    export.add_argument("--output-dir", required=True)
    export.add_argument("--require-metadata", action="store_true")
    export.add_argument("--jobs", type=int, default=1, help="inputs at once")
    export.add_argument("--stop-on-error", action="store_true")
    export.add_argument("inputs", nargs="+")
    merge = sub.add_parser("merge", help="merge training sets")
    merge.add_argument("--output-dir", required=True)
    merge.add_argument("input_dir", help="a folder whose children are training sets")
    return p


def _kind(first: object) -> str:
    name = first if isinstance(first, str) else next(iter(first))
    return {"Rosbag1IngestorConfig": ".bag", "Rosbag2IngestorConfig": ".mcap"}.get(name, "bundle")


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = session(args.master)
    if args.command == "merge":
        roots = discovery.datasets(args.input_dir)
        about = merge_training_sets(spark, roots, args.output_dir)
        print(f"merged {len(roots)} data sets: {about['total_episodes']} episodes, {about['total_frames']} frames")
        return 0
    if args.command == "run":
        job = Orchestrator.from_config(load_config(args.config))
        job.jobs = args.jobs or job.jobs
        kind = _kind(job.stage_configs[0])
        inputs = discovery.bundles(args.inputs) if kind == "bundle" else discovery.recordings(args.inputs, [kind])
    else:
        inputs = discovery.recordings(args.inputs)
        exports = lambda name: [{name: {"require_metadata": args.require_metadata}}, "UuidEnricherConfig", {"ParquetVideoExporterConfig": {"output_dir": args.output_dir}}]
        failed = 0
        for name, bag in (("Rosbag1IngestorConfig", True), ("Rosbag2IngestorConfig", False)):
            own = [p for p in inputs if p.endswith(".bag") == bag]
            if not (failed and args.stop_on_error):
                failed += _report(Orchestrator(exports(name), stop_on_error=args.stop_on_error, jobs=args.jobs).run(own, spark))
        return int(failed > 0)
    return int(_report(job.run(inputs, spark)) > 0)


def _report(results: dict[str, Exception | None]) -> int:
    for path, error in results.items():
        print(f"{path}: {'ok' if error is None else error}", file=sys.stderr if error else sys.stdout)
    return sum(e is not None for e in results.values())


if __name__ == "__main__":
    sys.exit(main())
