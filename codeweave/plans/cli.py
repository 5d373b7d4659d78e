"""Command line: ``python -m codeweave.plans.cli [--config F] COMMAND``."""

from __future__ import annotations

import argparse
import logging
import sys

from codeweave import runtime
from codeweave.plans.pipeline import Run
from codeweave.sources import config as conf
from codeweave.sources.client import Http, Offline, Retrying


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="codeweave")
    out.add_argument("--config", default="config.yaml")
    out.add_argument("--repo")
    out.add_argument("--output")
    out.add_argument("--artifacts")
    out.add_argument("--verbose", action="store_true")
    out.add_argument("--offline", action="store_true", help="deterministic replies; the plan is computed")
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("generate")
    update = commands.add_parser("update")
    for name in ("--base-ref", "--head-ref", "--changed-files"):
        update.add_argument(name, default="")
    commands.add_parser("plan")
    commands.add_parser("validate")
    return out


def configured(args: argparse.Namespace) -> conf.Config:
    """The file's values, checked, then the overrides of the command line."""
    config = conf.load(args.config)
    conf.validate(config, need_key=not args.offline)
    config.repo_path = args.repo or config.repo_path
    config.output_dir = args.output or config.output_dir
    config.artifacts_dir = args.artifacts or config.artifacts_dir
    config.verbose = args.verbose
    return config


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO)
    logging.getLogger("py4j").setLevel(logging.INFO)
    try:
        config = configured(args)
        llm = config.llm
        client = Offline() if args.offline else Retrying(Http(llm.base_url, llm.api_key, llm.agent_model, llm.timeout_seconds))
        run = Run(runtime.session(), config, client, computed_plan=args.offline)
        if args.command == "generate":
            run.generate()
        elif args.command == "update":
            run.update(args.changed_files, args.base_ref, args.head_ref)
        elif args.command == "plan":
            run.plan()
        else:
            report = run.validate()
            for link in report["broken_links"] or []:
                print(f"{link['source_file']}: {link['link_target']}")
            print(f"{len(report['broken_links'] or [])} of {report['total_links']} links are broken in {report['total_files']} files")
    except (conf.ConfigError, OSError, ValueError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
