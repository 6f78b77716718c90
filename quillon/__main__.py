"""Command line: sql, check, backup, restore.  Exit 0, 1 for an error, 2 for wrong usage."""

from __future__ import annotations

import datetime
import re
import sys

from quillon import database
from quillon.errors import EngineError
from quillon.plans.printer import real

USAGE = """usage: python -m quillon sql DATABASE [STATEMENTS]   statements from standard input if not given
       python -m quillon check DATABASE
       python -m quillon backup DATABASE TARGET
       python -m quillon restore BACKUP DATABASE
"""


def shown(v) -> str:
    """A value as text; texts that could be taken for something else are quoted."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, float):
        return real(v)
    if isinstance(v, bytes):
        return f"X'{v.hex()}'"
    if isinstance(v, datetime.datetime):
        text = v.strftime("%Y-%m-%dT%H:%M:%S.%f").rstrip("0").rstrip(".")
        return text + "Z"
    if isinstance(v, str) and (v == "" or re.search(r"[\x00-\x1f']", v) or v.upper() in ("NULL", "TRUE", "FALSE") or v != v.strip()):
        return "'" + v.replace("'", "''").replace("\t", "\\t").replace("\n", "\\n") + "'"
    return str(v)


def main(args: list[str], out=sys.stdout, err=sys.stderr, spark=None) -> int:
    want = {"sql": (1, 2), "check": (1, 1), "backup": (2, 2), "restore": (2, 2)}
    if not args or args[0] not in want or not want[args[0]][0] <= len(args) - 1 <= want[args[0]][1]:
        err.write(USAGE)
        return 2
    command, *rest = args
    try:
        if command == "sql":
            text = rest[1] if len(rest) > 1 else sys.stdin.read()

            def rows(result):
                out.write("\t".join(result.columns) + "\n")
                for r in result:
                    out.write("\t".join(map(shown, r)) + "\n")

            with database.open(rest[0], spark) as db:
                session = db.session()
                try:
                    session.script(text, rows)
                finally:
                    session.close()
        elif command == "check":
            r = database.check(rest[0], spark)
            out.write(f"ok: version {r.version}, {r.tables} tables, {r.indexes} indexes, {r.rows} rows, {r.parts} parts, {r.bytes} bytes, {r.orphans} unused parts\n")
        elif command == "backup":
            with database.open(rest[0], spark, read_only=True) as db:
                db.backup(rest[1])
        else:
            database.restore(rest[0], rest[1], spark)
    except EngineError as e:
        err.write(f"error: {e}\n")
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
