"""Small file operations on whatever file system a path names, through Spark's own configuration."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    jvm_path, system = _at(spark, path)
    return system.exists(jvm_path)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete a file or a folder with all it holds; false if there was none."""
    jvm_path, system = _at(spark, path)
    return system.delete(jvm_path, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, without Spark's markers and hidden files; none if there is no folder."""
    jvm_path, system = _at(spark, path)
    if not system.exists(jvm_path):
        return []
    names = (status.getPath().getName() for status in system.listStatus(jvm_path))
    return sorted(name for name in names if not name.startswith(("_", ".")))


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole: written under a hidden name, then renamed."""
    target, system = _at(spark, path)
    hidden, _ = _at(spark, f"{path.rsplit('/', 1)[0]}/.{path.rsplit('/', 1)[1]}.tmp")
    stream = system.create(hidden, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    system.delete(target, False)
    if not system.rename(hidden, target):
        raise OSError(f"could not write {path}")


def rename(spark: SparkSession, path: str, target: str) -> None:
    source, system = _at(spark, path)
    if not system.rename(source, _at(spark, target)[0]):
        raise OSError(f"could not rename {path} to {target}")


def read_small(spark: SparkSession, path: str) -> str:
    return "\n".join(row["value"] for row in spark.read.text(path).collect())
