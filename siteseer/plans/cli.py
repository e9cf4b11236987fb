"""Command line: five subcommands over the functions in ``api``."""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from ..operators.scoring import read_model
from ..sources.inputs import Budget
from . import api


def not_negative(s: str) -> int:
    if (n := int(s)) < 0:
        raise argparse.ArgumentTypeError("must not be negative")
    return n


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="siteseer")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        c.add_argument("--outdir", required=True)
        c.add_argument("--threads", type=not_negative, default=0, help="local cores; 0: the master that Spark is configured with, else all cores")
        c.add_argument("--verbosity", type=int, choices=range(4), default=1)
        c.add_argument("--debug", action="store_true")
        return c

    c = command("add-variants")
    c.add_argument("--vcf", nargs="*", default=[])
    c.add_argument("--genome", required=True)
    c.add_argument("--indels", action="store_true")
    c.add_argument("--keep", action="store_true")
    c = command("index-genome")
    c.add_argument("--genome", required=True)
    c.add_argument("--pam", required=True)
    c.add_argument("--bmax", type=not_negative, default=0)
    c = command("search")
    c.add_argument("--index-genome", required=True)
    c.add_argument("--guides", required=True)
    c.add_argument("--mm", type=not_negative, default=0)
    c.add_argument("--bdna", type=not_negative, default=0)
    c.add_argument("--brna", type=not_negative, default=0)
    c.add_argument("--bulge-mode", choices=("mixed", "single"), default="mixed")
    c.add_argument("--score", nargs=2, metavar=("MISMATCHES", "PAMS"))
    c.add_argument("--output-mode", choices=("targets", "profile", "both"), default="both")
    c.add_argument("--sort", choices=("edits", "coordinates"), default="edits")
    c.add_argument("--layout", choices=("scored", "plain", "legacy"), default="scored")
    c.add_argument("--single-file", action="store_true", help="one sorted file instead of sorted parts")
    c = command("annotate-results")
    c.add_argument("--targets", required=True)
    c.add_argument("--annotations", nargs="+", required=True)
    c.add_argument("--annotation-names", nargs="+")
    c.add_argument("--minus-pos", choices=("rightmost", "leftmost"), default="rightmost")
    c.add_argument("--single-file", action="store_true")
    c = command("generate-report")
    c.add_argument("--input", required=True)
    c.add_argument("--mm", type=not_negative, help="ceiling of mismatches; without it the largest number found")
    c.add_argument("--guide", action="append", help="a guide for the tables per guide; without it all")
    c.add_argument("--prefix", default="report")
    c.add_argument("--figures", action="store_true", help="draw PNG files too; needs matplotlib")
    return p


class UsageError(ValueError):
    """Arguments that do not go together."""


def threads(n: int) -> str:
    cores = os.cpu_count() or 1
    if n > cores:
        raise UsageError(f"{n} threads asked for, {cores} cores here")
    return f"local[{n or '*'}]"


def exit_code(e: BaseException) -> int:
    """The system's exit code for a failure, by its kind."""
    said = str(e)
    if isinstance(e, UsageError):
        return os.EX_USAGE
    if isinstance(e, FileNotFoundError) or "PATH_NOT_FOUND" in said or "FileNotFoundException" in said:
        return os.EX_NOINPUT
    if isinstance(e, FileExistsError) or "PATH_ALREADY_EXISTS" in said:
        return os.EX_CANTCREAT
    if isinstance(e, OSError) or "java.io.IOException" in said:
        return os.EX_IOERR
    if isinstance(e, KeyboardInterrupt):
        return os.EX_OSERR
    if isinstance(e, ValueError) or "USER_RAISED_EXCEPTION" in said or isinstance(e, PySparkException):
        return os.EX_DATAERR
    return os.EX_SOFTWARE


def run(a: argparse.Namespace, spark: SparkSession) -> None:
    if a.command == "add-variants":
        api.add_variants(spark, a.genome, a.vcf, a.outdir, a.indels, a.keep)
    elif a.command == "index-genome":
        api.index_genome(spark, a.genome, api.read_pam(spark, a.pam), a.outdir, a.bmax)
    elif a.command == "search":
        model = read_model(spark, *a.score) if a.score else None
        api.search_offtargets(spark, a.index_genome, a.guides, Budget(a.mm, a.bdna, a.brna, a.bulge_mode == "single"), a.outdir, a.output_mode, model, a.sort, a.layout, a.single_file)
    elif a.command == "annotate-results":
        api.annotate_results(spark, a.targets, a.annotations, a.outdir, a.annotation_names, a.minus_pos, a.single_file)
    else:
        made = api.generate_report(spark, a.input, a.mm, a.outdir, a.guide, a.prefix)
        if a.figures:
            api.draw(spark, made, a.outdir)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        b = SparkSession.builder.appName("siteseer")
        if a.threads:  # else the master comes from spark-submit or the configuration
            b = b.master(threads(a.threads))
        spark = b.getOrCreate()
        spark.sparkContext.setLogLevel(("OFF", "ERROR", "WARN", "INFO")[a.verbosity])
        run(a, spark)
    except (Exception, KeyboardInterrupt) as e:  # the session's own errors included
        if a.debug:
            raise
        print(f"siteseer {a.command}: {e}", file=sys.stderr)
        return exit_code(e)
    return os.EX_OK


if __name__ == "__main__":
    sys.exit(main())
