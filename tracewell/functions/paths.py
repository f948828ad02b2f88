"""Which paths a repository shouldn't hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Folders of runs, endings of data, models and credentials, and of what packs them.
RUN_FOLDERS = (".local", "data", "raw", "normalized", "datasets", "models", "runs", "exports", "logs", "source-artifacts")
ENDINGS = (
    ".sqlite", ".sqlite3", ".db", ".parquet", ".har", ".pem", ".key", ".p12", ".pfx", ".pt", ".pth", ".ckpt", ".onnx",
    ".safetensors", ".pkl", ".pickle", ".joblib",
)
PACKED = (".gz", ".bz2", ".xz", ".zst", ".zip")
SAMPLES = (".env.example", ".env.sample", ".env.template")


def _any(endings: tuple[str, ...]) -> str:
    return "|".join(e.replace(".", r"\.") for e in endings)


def violation(path: Column, source_root: str = "") -> Column:
    """Why a path may not be kept; null if it may. ``source_root``: a folder whose Python files are exempt from the folder rule."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    name = F.lower(F.try_element_at(parts, F.lit(-1)))
    bare = F.regexp_replace(F.regexp_replace(name, rf"({_any(PACKED)})+\z", ""), r"-(wal|shm|journal)\z", "")
    folders = F.transform(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0))), F.lower)
    exempt = F.lit(False) if not source_root else path.startswith(source_root.rstrip("/") + "/") & name.rlike(r"\.pyi?\z")
    out = F.when((F.size(parts) < 1) | path.startswith("/") | F.array_contains(parts, ".."), "invalid path")
    out = out.when((name == ".env") | name.startswith(".env.") & ~name.isin(*SAMPLES), "environment file")
    out = out.when(bare.rlike(rf"({_any(ENDINGS)})\z"), "data, model or credential file")
    return out.when(F.arrays_overlap(folders, F.array(*[F.lit(f) for f in RUN_FOLDERS])) & ~exempt, "run folder")
