"""Small driver-side files through Hadoop's FileSystem, so any store that Spark reads will do."""

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")

    def _path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        return self._path().getFileSystem(self._conf)

    def names(self, name: str = "") -> list[str]:
        fs, p = self._fs(), self._path(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, name: str = "") -> None:
        self._fs().delete(self._path(name), True)

    def read_json(self, name: str) -> dict:
        stream = self._fs().open(self._path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write_json(self, name: str, value: dict) -> bool:
        """Publish a file under a new name; False if the name is taken.

        The text is whole before the name exists: it is written beside it, then renamed without overwriting. A writer that
        dies before the rename leaves a file that no one waits for.
        """
        fs, options = self._fs(), self._jvm.org.apache.hadoop.fs.Options.Rename
        temp = self._path(f"_temp.{uuid.uuid4().hex}")
        fs.mkdirs(self._path())
        out = fs.create(temp, False)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        none = self._jvm.java.lang.reflect.Array.newInstance(options.NONE.getClass(), 1)
        none[0] = options.NONE
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri(), self._conf).rename(temp, self._path(name), none)
        except Py4JJavaError as e:
            fs.delete(temp, False)
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        return True
