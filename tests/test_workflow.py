"""All steps in a row, from raw files to evaluated scores, through the command line."""

import gzip
import io
import random
import tarfile

import pytest

from driftlake import cli, config
from driftlake.plans.workflow import Workflow


def test_steps(spark, tmp_path):
    rng = random.Random(1)
    genomes = [f"G{i:02d}" for i in range(12)]
    for source in ("bac", "ar"):
        with gzip.open(tmp_path / f"{source}.tsv.gz", "wt") as f:
            for g in genomes[:8] if source == "bac" else genomes[8:]:
                f.write(f"{g}\td__X;p__P{int(g[1:]) % 3};g__a;s__\n")
    with gzip.open(tmp_path / "m.tsv.gz", "wt") as f:
        f.write("accession\tgtdb_representative\n" + "".join(f"{g}\tt\n" for g in genomes[:11]) + "G11\tf\n")
    hits_then, hits_now = [], []
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as tar:
        for g in genomes[:10]:
            text = ""
            for p in range(30):
                family = f"PF{p % 4}.1"
                base = ["ACDEFG", "HIKLMN", "PQRSTV", "WYACHP"][p % 4]
                text += f">p{p} {g}\n{''.join(rng.choice(base + 'GL') for _ in range(60))}\n"
                if p < 20:
                    hits_then.append((g, f"p{p}", family))
                if p < 20 or p % 4 == 0:
                    hits_now.append((g, f"p{p}", family if p < 20 else "PF99.2"))
            data = text.encode()
            info = tarfile.TarInfo(f"d/{g}_protein.faa")
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    for name, rows in (("then", hits_then), ("now", hits_now)):
        spark.createDataFrame(rows, "genome string, protein_id string, family string").write.parquet(str(tmp_path / name))
    run = lambda command, *args: cli.main([command, "--root", str(tmp_path / "root"), *map(str, args)], spark)
    run("preprocess-taxonomy", "--bac", tmp_path / "bac.tsv.gz", "--ar", tmp_path / "ar.tsv.gz")
    run("build-genome-panel", "--metadata", tmp_path / "m.tsv.gz", "--target-total", 11)
    for _ in range(2):
        run("extract-panel", "--archives", tmp_path / "x.tar.gz")
        run("label-panel", "--hits-t0", tmp_path / "then", "--hits-t1", tmp_path / "now")
    run("build-embedding-sample", "--dark-negative-cap", 40, "--characterised-cap", 150)
    run("embed-panel-sample")
    run("score-novelty")
    run("compare-embeddings", "--hits", tmp_path / "now", "--n-genomes", 6)
    run("log-experiment", "--title", "done")
    w = Workflow(spark, str(tmp_path / "root"), "R207")
    n = w.read("panel_sequences").select("genome").distinct().count()
    labels = w.read("panel_labels")
    assert n >= 5 and labels.count() == 30 * n and labels.where("dark").count() == 10 * n and labels.where("positive").count() == 3 * n
    got = {r["category"]: r["count"] for r in w.read("embedding_sample").groupBy("category").count().collect()}
    assert got["positive"] == 3 * n and got["dark_negative"] == min(40, 7 * n) and 0 < got["characterised_at_t0"] <= min(150, 20 * n)
    scores = w.read("kmers_novelty_scores")
    assert scores.count() == got["positive"] + got["dark_negative"] and scores.where("evt_novelty_score < 0 or evt_novelty_score > 1").count() == 0
    gap = w.compare_embeddings("kmers", spark.read.parquet(str(tmp_path / "now"))).first()
    assert gap["n_families"] >= 3 and gap["separation_gap"] > 0.03
    single = spark.read.parquet(str(tmp_path / "then"))
    found = w.evaluate("kmers", single, min_family_size=5, precision_k=(5, 10), q=0.8)
    assert 0 <= found["held_out"].first()["auroc"] <= 1 and found["precision"].count() == 2 and found["roc"].count() == 200
    with pytest.raises(FileNotFoundError):
        w.evaluate("none", single)
    assert w.read("run_log").count() >= 3


def test_embed(spark, tmp_path):
    (tmp_path / "a.faa").write_text(">x\nACGT\n>y\nGGTT\n")
    cli.main(["embed", "--fasta", str(tmp_path / "a.faa"), "--out", str(tmp_path / "o")], spark)
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("k: 7\nprecision_k: [1, 2]\n")
    assert config.scorer(config.load(tmp_path / "c.yaml")).precision_k == (1, 2)
    with pytest.raises(ValueError, match="unknown"):
        config.scorer({"odd": 1})
