"""What a release of the public taxonomy and of the family library consists of, and fetching it."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path
from urllib.error import HTTPError

from pyspark.sql import SparkSession

from .fetch import download, verify_md5
from .sinks import append_manifest

# Public addresses and file names of the releases.
TAXONOMY = "https://data.gtdb.ecogenomic.org/releases/release{n}/{n}.0"
TAXONOMY_FILES = ("bac120_taxonomy_r{n}", "ar53_taxonomy_r{n}", "bac120_metadata_r{n}", "ar53_metadata_r{n}")
TAXONOMY_ENDINGS = (".tsv.gz", ".tar.gz", ".tsv")
TAXONOMY_NOTES = ("VERSION.txt", "MD5SUM.txt")
TAXONOMY_PROTEINS = "genomic_files_reps/gtdb_proteins_aa_reps_r{n}.tar.gz"
FAMILIES = "https://ftp.ebi.ac.uk/pub/databases/Pfam/releases/Pfam{n}"
FAMILY_NOTES, FAMILY_LIBRARY = ("Pfam.version.gz", "relnotes.txt", "Pfam-A.clans.tsv.gz"), ("Pfam-A.hmm.gz",)


def release_number(tag: str) -> str:
    return tag.lstrip("Rr")


def _first_found(base: str, stem: str, endings: tuple[str, ...], folder: Path, get: Callable[[str, Path], int]) -> Path:
    """The file with the first ending that the server has; a file that is there stays. Only "not found" tries the next."""
    for ending in endings:
        if (folder / (stem + ending)).exists():
            return folder / (stem + ending)
    for k, ending in enumerate(endings):
        to = folder / (stem + ending)
        part = to.with_name(to.name + ".part")
        try:
            get(f"{base}/{stem}{ending}", part)
        except HTTPError as e:
            part.unlink(missing_ok=True)
            if e.code != 404 or k == len(endings) - 1:
                raise
        else:
            part.replace(to)  # whole or not at all
            return to
    raise AssertionError


def fetch_taxonomy(release: str, folder: Path, proteins: bool = False, metadata: bool = True, get: Callable[[str, Path], int] = download) -> dict[str, int]:
    """Sizes by file name; checked against the release's sums, where it has them."""
    n = release_number(release)
    base, folder = TAXONOMY.format(n=n), Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    stems = [(s.format(n=n), TAXONOMY_ENDINGS) for s in TAXONOMY_FILES if metadata or "metadata" not in s]
    stems += [(s, ("",)) for s in TAXONOMY_NOTES]
    if proteins:
        stems.append((TAXONOMY_PROTEINS.format(n=n), ("",)))
        (folder / TAXONOMY_PROTEINS.format(n=n)).parent.mkdir(parents=True, exist_ok=True)
    got = [_first_found(base, stem, endings, folder, get) for stem, endings in stems]
    sums = dict(reversed(line.split()[:2]) for line in (folder / "MD5SUM.txt").read_text().splitlines() if len(line.split()) >= 2)
    named = {name.rsplit("/", 1)[-1]: value for name, value in sums.items()}
    for path in got:
        if path.name in named:
            verify_md5(path, named[path.name])
    return {path.relative_to(folder).as_posix(): path.stat().st_size for path in got}


def fetch_families(release: str, folder: Path, metadata_only: bool = False, get: Callable[[str, Path], int] = download) -> dict[str, int]:
    """Sizes by file name of a family library: its notes and, unless `metadata_only`, its models."""
    base, folder = FAMILIES.format(n=release), Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    names = FAMILY_NOTES if metadata_only else FAMILY_NOTES + FAMILY_LIBRARY
    return {name: _first_found(base, name, ("",), folder, get).stat().st_size for name in names}


def snapshot(spark: SparkSession, source: str, release: str, folder: str, metadata_only: bool = False, get: Callable[[str, Path], int] = download) -> dict[str, int]:
    """Fetches a release and notes it in the folder's manifest."""
    to = Path(folder) / source / release
    if source == "taxonomy":
        sizes, host = fetch_taxonomy(release, to, proteins=not metadata_only, get=get), TAXONOMY
    elif source == "families":
        sizes, host = fetch_families(release, to, metadata_only, get), FAMILIES
    else:
        raise ValueError(f"unknown source {source!r}: taxonomy or families")
    append_manifest(spark, f"{folder}/manifest", source, release, sizes, host.split("/")[2])
    return sizes
