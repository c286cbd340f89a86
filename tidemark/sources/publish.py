"""Publishing small result tables to a database by any DB-API connection, and files as text or base64.

The tables are months, daily curves and orders: bounded, so that one transaction
of the driver holds them. ``mark`` is the driver's placeholder, ``?`` or ``%s``.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Sequence
from pathlib import PurePath

from pyspark.sql import DataFrame

TEXT = {".json", ".csv", ".md"}
LIMIT = 1_000_000


def encode_file(name: str, content: bytes) -> tuple[str, str]:
    """(content, encoding): text files as utf-8, others as base64."""
    if PurePath(name).suffix in TEXT:
        return content.decode("utf-8"), "utf-8"
    return base64.b64encode(content).decode("ascii"), "base64"


def decode_file(content: str, encoding: str) -> bytes:
    return content.encode("utf-8") if encoding == "utf-8" else base64.b64decode(content)


class Publisher:
    """Each call is one transaction: all of it is visible or nothing."""

    def __init__(self, connect: Callable, mark: str = "?"):
        self.connect, self.mark = connect, mark

    def _rows(self, df: DataFrame) -> list[tuple]:
        rows = [tuple(r) for r in df.limit(LIMIT + 1).collect()]
        if len(rows) > LIMIT:
            raise ValueError(f"more than {LIMIT} rows: write this table with a distributed sink")
        return rows

    def _insert(self, table: str, columns: Sequence[str]) -> str:
        return f"insert into {table} ({', '.join(columns)}) values ({', '.join([self.mark] * len(columns))})"

    def _run(self, statements: Sequence[tuple[str, list[tuple]]]) -> None:
        conn = self.connect()
        try:
            cursor = conn.cursor()
            for sql, rows in statements:
                if rows:
                    cursor.executemany(sql, rows)
            conn.commit()
        except BaseException:
            conn.rollback()
            raise
        finally:
            conn.close()

    def replace(self, table: str, df: DataFrame) -> int:
        """Deletes the table's rows and inserts these; how many."""
        rows = self._rows(df)
        self._run([(f"delete from {table}", [()]), (self._insert(table, df.columns), rows)])
        return len(rows)

    def upsert(self, table: str, df: DataFrame, keys: Sequence[str]) -> int:
        """Inserts rows, or updates those whose key exists; how many."""
        rows = self._rows(df)
        rest = [c for c in df.columns if c not in keys]
        action = "update set " + ", ".join(f"{c} = excluded.{c}" for c in rest) if rest else "nothing"
        self._run([(f"{self._insert(table, df.columns)} on conflict ({', '.join(keys)}) do {action}", rows)])
        return len(rows)

    def put_files(self, table: str, files: dict[str, bytes]) -> int:
        """Upserts (path, content, encoding)."""
        rows = [(name, *encode_file(name, content)) for name, content in sorted(files.items())]
        sql = self._insert(table, ["path", "content", "encoding"]) + " on conflict (path) do update set content = excluded.content, encoding = excluded.encoding"
        self._run([(sql, rows)])
        return len(rows)
