"""Files through Spark's own file systems: facts, digests and ranges, for any store that Spark can read."""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from gridloom.model import RequestError, fields, require

PAGE = 1 << 16


def _open(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def is_local(path: str) -> bool:
    return "://" not in path and not path.startswith(("viewfs:", "hdfs:", "s3a:")) or path.startswith("file:")


def facts(spark: SparkSession, path: str) -> dict:
    """Length and time of the last change."""
    fs, p = _open(spark, path)
    status = fs.getFileStatus(p)
    return {"length": status.getLen(), "modified": status.getModificationTime()}


def digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of the content, read as a stream."""
    fs, p = _open(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
    finally:
        stream.close()


@dataclass
class Ranges:
    """Random access to a file's bytes; pages that were read are kept."""

    spark: SparkSession
    path: str
    pages: dict[int, bytes] = field(default_factory=dict)

    def read(self, at: int, n: int) -> bytes:
        out = b""
        for page in range(at // PAGE, -(-(at + n) // PAGE)):
            if page not in self.pages:
                fs, p = _open(self.spark, self.path)
                size = min(PAGE, fs.getFileStatus(p).getLen() - page * PAGE)
                require(size > 0, "the file is too short")
                stream = fs.open(p)
                try:
                    stream.seek(page * PAGE)
                    self.pages[page] = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(size)))
                finally:
                    stream.close()
            out += self.pages[page]
        skip = at % PAGE
        require(len(out) >= skip + n, "the file is too short")
        return out[skip : skip + n]


def unpack(data, form: str, at: int) -> tuple:
    """Values at a place of bytes or of Ranges."""
    return struct.unpack(form, data.read(at, struct.calcsize(form))) if isinstance(data, Ranges) else struct.unpack_from(form, data, at)


def piece(data, at: int, n: int) -> bytes:
    return data.read(at, n) if isinstance(data, Ranges) else bytes(data[at : at + n])


@dataclass
class Identity:
    """What a file was when it was registered. policy: ``verify`` compares the content's digest, ``trusted_manifest`` takes the declared one."""

    spark: SparkSession
    path: str
    length: int
    modified: int
    sha256: str

    @classmethod
    def of(cls, spark: SparkSession, path: str, declared: dict | None = None) -> Identity:
        declared = fields(declared or {}, ("sha256", "length", "policy"))
        policy = declared.get("policy", "verify")
        require(policy in ("verify", "trusted_manifest"), "the identity policy is verify or trusted_manifest")
        require(policy == "verify" or "sha256" in declared, "a trusted manifest declares the digest")
        now = facts(spark, path)
        require(declared.get("length", now["length"]) == now["length"], "the file's length is not as declared")
        found = declared["sha256"] if policy == "trusted_manifest" else digest(spark, path)
        require(declared.get("sha256", found) == found, "the file's content is not as declared")
        return cls(spark, path, now["length"], now["modified"], found)

    def check(self, content: bool = False) -> None:
        """Fail if the file has been replaced or changed; ``content``: by its digest too."""
        try:
            now = facts(self.spark, self.path)
        except Exception as e:
            raise RequestError("the file is gone") from e
        require((now["length"], now["modified"]) == (self.length, self.modified), "the file has changed")
        require(not content or digest(self.spark, self.path) == self.sha256, "the file's content has changed")
