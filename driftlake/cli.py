"""python -m driftlake.cli COMMAND --root DIR --release R ...: the workflow's steps."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .operators import families
from .plans.workflow import Workflow, compare_fasta, embed_fasta, families_of, smoke
from .sources import releases, streams, upload


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="driftlake")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *flags: tuple, rooted: bool = True) -> None:
        p = commands.add_parser(name)
        if rooted:
            p.add_argument("--root", required=True)
            p.add_argument("--release", default="R207")
        for flag, options in flags:
            p.add_argument(flag, **options)

    whole = lambda n: {"type": int, "default": n}
    must = {"required": True}
    model = ("--model", {"default": "kmers"})
    add("preprocess-taxonomy", ("--bac", must), ("--ar", must))
    add("build-genome-panel", ("--metadata", {"nargs": "+", "required": True}), ("--target-total", whole(500)), ("--floor", whole(2)), ("--cap", whole(30)), ("--seed", whole(42)))
    add("extract-panel", ("--archives", must), ("--suffix", {"default": "_protein.faa"}))
    add("label-panel", ("--hits-t0", must), ("--hits-t1", must), ("--limit-genomes", {"type": int}))
    add("build-embedding-sample", ("--dark-negative-cap", whole(30000)), ("--characterised-cap", whole(30000)), ("--seed", whole(42)))
    add("embed", model, ("--fasta", must), ("--out", must), ("--batch-size", whole(64)), rooted=False)
    add("embed-panel-sample", model, ("--batch-size", whole(64)))
    add("compare-embeddings", model, ("--hits", must), ("--n-genomes", whole(30)), ("--per-family", whole(5)), ("--max-families", whole(20)), ("--seed", whole(42)))
    add("score-novelty", model, ("--k", whole(5)), ("--threshold-quantile", {"type": float, "default": 0.9}), ("--below", {"choices": ["zero", "ecdf"], "default": "zero"}))
    add("evaluate-novelty", model, ("--hits", must), ("--k", whole(5)), ("--threshold-quantile", {"type": float, "default": 0.9}), ("--min-family-size", whole(20)), ("--precision-k", {"type": int, "nargs": "+", "default": [50, 100, 500, 1000]}), ("--calibration-bins", whole(10)))
    add("extract-nucleotides", ("--archives", must), ("--suffix", {"default": "_protein.fna"}))
    add("search-families", ("--library", must), ("--out", must), ("--cpus", whole(4)), ("--limit-genomes", {"type": int}))
    add("compare-fasta", model, ("--fasta", must), ("--hits", must), ("--per-family", whole(4)), ("--max-families", whole(6)), rooted=False)
    add("fetch-snapshot", ("--source", {"choices": ["taxonomy", "families"], "required": True}), ("--release", must), ("--folder", must), ("--metadata-only", {"action": "store_true"}), rooted=False)
    add("upload-archive", ("--url", must), ("--bucket", must), ("--key", must), ("--profile", {}), ("--workers", whole(6)), rooted=False)
    add("smoke-test", ("--models", {"nargs": "+", "default": ["kmers", "masked-kmers"]}), rooted=False)
    add("log-experiment", ("--title", must), ("--config", {"default": ""}), ("--result", {"default": ""}), ("--next", {"default": ""}))
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(args)
    spark = spark or SparkSession.builder.getOrCreate()
    if a.command == "embed":
        embed_fasta(spark, a.fasta, a.model, a.batch_size).write.mode("overwrite").parquet(a.out)
        return
    if a.command == "compare-fasta":
        compare_fasta(spark, a.fasta, spark.read.parquet(a.hits), a.model, a.per_family, a.max_families).show()
        return
    if a.command == "fetch-snapshot":
        for name, size in releases.snapshot(spark, a.source, a.release, a.folder, a.metadata_only).items():
            print(name, size)
        return
    if a.command == "upload-archive":
        print(upload.upload(upload.S3Store(a.bucket, a.profile), a.key, *streams.ranges(a.url), workers=a.workers), "parts sent")
        return
    if a.command == "smoke-test":
        smoke(spark, a.models).show()
        return
    w = Workflow(spark, a.root, a.release)
    read = spark.read.parquet
    if a.command == "preprocess-taxonomy":
        w.preprocess_taxonomy({"bac": a.bac, "ar": a.ar})
    elif a.command == "build-genome-panel":
        w.build_panel(a.metadata, a.target_total, a.floor, a.cap, a.seed)
    elif a.command == "extract-panel":
        _, missing = w.extract_panel(a.archives, a.suffix)
        missing.show()
    elif a.command == "extract-nucleotides":
        _, missing = w.extract_panel(a.archives, a.suffix, "panel_nucleotides")
        missing.show()
    elif a.command == "search-families":
        w.search(families.profile_library(a.library, a.cpus), a.limit_genomes).write.mode("overwrite").parquet(a.out)
    elif a.command == "label-panel":
        then, now = read(a.hits_t0), read(a.hits_t1)
        w.label(then, now, families_of(then), families_of(now), a.limit_genomes)
    elif a.command == "build-embedding-sample":
        w.build_embedding_sample(a.dark_negative_cap, a.characterised_cap, a.seed).groupBy("category").count().show()
    elif a.command == "embed-panel-sample":
        print(f"{w.embed_sample(a.model, a.batch_size)[1]} without a sequence")
    elif a.command == "compare-embeddings":
        w.compare_embeddings(a.model, read(a.hits), a.n_genomes, a.per_family, a.max_families, a.seed).show()
    elif a.command == "score-novelty":
        w.score(a.model, a.k, a.threshold_quantile, a.below)
    elif a.command == "evaluate-novelty":
        for name, table in w.evaluate(a.model, read(a.hits), a.k, a.threshold_quantile, a.min_family_size, tuple(a.precision_k), a.calibration_bins).items():
            w.write(f"{a.model}_{name}", table)
    elif a.command == "log-experiment":
        w.log(a.title, a.config, a.result, a.next)


if __name__ == "__main__":
    main()
