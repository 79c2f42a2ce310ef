"""Command line: analyze, plan, generate, export. Exit codes: 0 done, 1 bad input, 2 unbreakable cycle,
3 files, 4 plan or configuration, 5 run stopped."""

from __future__ import annotations

import argparse
import json
import sys
from collections import Counter
from dataclasses import asdict
from pathlib import Path

from tessera.functions.generators import GeneratorError
from tessera.functions.rules import Rule, RuleError, ordered
from tessera.operators.assign import InfeasibleError
from tessera.plans.choices import choose
from tessera.plans.schema import SchemaError, load_steps
from tessera.sources.config import Config, ConfigError, read_config
from tessera.sources.ddl import read_ddl


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tessera")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("analyze", "plan", "generate", "export"):
        command = commands.add_parser(name)
        command.add_argument("sql")
        command.add_argument("--json", action="store_true")
        if name != "analyze":
            command.add_argument("-c", "--config")
        if name in ("generate", "export"):
            command.add_argument("-o", "--out", required=True)
            command.add_argument("--dry-run", action="store_true")
        if name == "generate":
            command.add_argument("--format", choices=["csv", "json"], default="csv")
    return parser


def main(argv: list[str] | None = None) -> int:
    args = _arguments().parse_args(argv)
    try:
        schema = read_ddl(Path(args.sql).read_text(encoding="utf-8"))
    except OSError as e:
        return _fail(e, 3)
    except SchemaError as e:
        return _fail(e, 1)
    try:
        steps = load_steps(schema)
    except SchemaError as e:
        return _fail(e, 2)
    if args.command == "analyze":
        print(json.dumps({"schema": asdict(schema), "hash": schema.hash(), "kinds": schema.kinds(), "steps": [asdict(s) for s in steps], "warnings": schema.warnings}, default=str, indent=None if args.json else 2))
        return 0
    try:
        config = read_config(args.config) if args.config else Config()
        warnings = list(schema.warnings)
        choices = choose(schema, config, warnings)
        rules = {name: ordered([Rule(text, i) for i, text in enumerate(t.rules)], assertions=True) for name, t in config.tables.items() if t.rules}
    except OSError as e:
        return _fail(e, 3)
    except (ConfigError, SchemaError, GeneratorError, RuleError) as e:
        return _fail(e, 4)
    if args.command == "plan":
        tables = {t: {c: asdict(x) for c, x in columns.items()} for t, columns in choices.items()}
        summary = Counter(x.source for columns in choices.values() for x in columns.values())
        found = {t: [{"kind": r.kind, "column": r.column, "text": r.text} for r in of] for t, of in rules.items()}
        plan = {"tables": tables, "rules": found, "steps": [asdict(s) for s in steps], "summary": summary, "warnings": warnings}
        print(json.dumps(plan, default=str, indent=None if args.json else 2))
        return 0
    return _generate(args, schema, config)


def _generate(args: argparse.Namespace, schema, config: Config) -> int:
    from pyspark.sql import SparkSession

    from tessera.operators.validate import quarantine_summary
    from tessera.plans.dataset import GenerationError, generate
    from tessera.sinks import files

    spark = SparkSession.builder.appName("tessera").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        data = generate(spark, schema, config)
        if args.dry_run:
            for t in schema.tables:
                print(t.name)
                data.rows(t.name).orderBy("idx").limit(10).show(truncate=False)
        elif args.command == "export":
            files.write_sql(data, args.out, config.batch_size)
        elif args.format == "csv":
            files.write_csv(data, args.out)
        else:
            files.write_json(data, args.out)
        for row in quarantine_summary(data.quarantine, "idx").collect():  # a row for each table
            print(f"{row['table']}: {row['rows']} rows in quarantine ({row['first_reason']})", file=sys.stderr)
    except (GenerationError, InfeasibleError) as e:
        return _fail(e, 5)
    except (GeneratorError, SchemaError, RuleError, files.ExportError) as e:
        return _fail(e, 4)
    return 0


def _fail(error: Exception, code: int) -> int:
    print(f"error: {error}", file=sys.stderr)
    return code


if __name__ == "__main__":
    sys.exit(main())
