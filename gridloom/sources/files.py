"""A data source for folders of many small or large binary files: format ``file_prefixes``.

Reading plans partitions of files from the listing alone and takes only the
first ``prefix`` bytes of each (all of it where ``prefix`` is negative); filters
on path and length are answered from the listing, so files they exclude are
never opened.  Writing makes one file for each row (name, content): the file is
written under a temporary name and renamed, so that a repeated task leaves whole
files only.

Options: ``path`` (folder; any file system that pyarrow knows by URI),
``pattern`` (of file names, default ``*``), ``prefix`` (default 64),
``filesPerTask`` (default 512).
"""

import fnmatch
import functools
import operator
import os
import uuid

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

SCHEMA = "path string, length long, prefix binary, bytes_read int"
FORMAT = "file_prefixes"


def _place(path):
    """(file system, path within it) of a folder given as URI or plain path."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


_TESTS = {
    ds.EqualTo: operator.eq, ds.GreaterThan: operator.gt, ds.GreaterThanOrEqual: operator.ge, ds.LessThan: operator.lt,
    ds.LessThanOrEqual: operator.le, ds.In: lambda a, b: a in b, ds.StringStartsWith: str.startswith,
    ds.StringEndsWith: str.endswith, ds.StringContains: operator.contains,
}


def _test(f):
    """(column, predicate) of a filter that the listing can answer, or None."""
    if isinstance(f, ds.IsNotNull) and f.attribute in (("path",), ("length",)):
        return f.attribute[0], lambda v: True
    if type(f) not in _TESTS or f.attribute not in (("path",), ("length",)):
        return None
    return f.attribute[0], functools.partial(lambda test, value, v: test(v, value), _TESTS[type(f)], f.value)


class _Reader(ds.DataSourceReader):
    def __init__(self, options):
        self.folder, self.pattern = options["path"], options.get("pattern", "*")
        self.prefix, self.per_task = int(options.get("prefix", 64)), int(options.get("filesPerTask", 512))
        self.tests = []

    def pushFilters(self, filters):
        for f in filters:
            test = _test(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)

    def partitions(self):
        from pyarrow import fs

        system, folder = _place(self.folder)
        found = [
            {"path": i.path, "length": i.size} for i in system.get_file_info(fs.FileSelector(folder, recursive=True))
            if i.is_file and fnmatch.fnmatch(i.base_name, self.pattern) and not i.base_name.startswith((".", "_"))
        ]
        kept = sorted((f["path"], f["length"]) for f in found if all(test(f[c]) for c, test in self.tests))
        return [ds.InputPartition(kept[i : i + self.per_task]) for i in range(0, len(kept), self.per_task)] or [ds.InputPartition([])]

    def read(self, partition):
        system, _ = _place(self.folder)
        names, types = ["path", "length", "prefix", "bytes_read"], [pa.string(), pa.int64(), pa.binary(), pa.int32()]
        rows, size = [], 0
        for path, length in partition.value:
            with system.open_input_file(path) as f:
                data = f.read(self.prefix) if self.prefix >= 0 else f.read()
            rows.append((path, length, data, len(data)))
            size += len(data)
            if size > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


class _Writer(ds.DataSourceWriter):
    def __init__(self, options, overwrite):
        self.folder, self.overwrite = options["path"], overwrite
        system, folder = _place(self.folder)
        system.create_dir(folder, recursive=True)
        if overwrite:
            system.delete_dir_contents(folder)

    def write(self, rows):
        system, folder = _place(self.folder)
        for r in rows:
            whole = f"{folder}/{r['name']}"
            part = f"{folder}/.{r['name']}.{uuid.uuid4().hex}"
            with system.open_output_stream(part) as f:
                f.write(bytes(r["content"]))
            system.move(part, whole)
        return ds.WriterCommitMessage()

    def commit(self, messages):
        pass

    def abort(self, messages):
        pass  # whole files under their final names are those a later attempt writes again


class FilePrefixes(ds.DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def register(spark: SparkSession):
    """Make the format known to a session and let it answer filters (a setting of the session)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FilePrefixes)


def file_prefixes(spark: SparkSession, folder: str, pattern="*", prefix=64, files_per_task=512):
    """First bytes of the files of a folder: path, length, prefix, bytes_read."""
    register(spark)
    options = {"pattern": pattern, "prefix": str(prefix), "filesPerTask": str(files_per_task)}
    return spark.read.format(FORMAT).options(**options).load(folder)


def write_files(df, folder: str, mode="append"):
    """One file for each row of (name, content) in ``folder``; of rows with equal names one stays."""
    register(df.sparkSession)
    df.select("name", "content").write.format(FORMAT).mode(mode).save(folder)
