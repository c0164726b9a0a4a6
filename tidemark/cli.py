"""Commands on a table: a script as a relation, and a prompt.

    python -m tidemark.cli [FOLDER]
"""

from __future__ import annotations

import sys
import time
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.runs import running_last, running_total
from tidemark.table import Table

# Commands and their other names.
ALIASES = {"put": "put", "set": "put", "update": "put", "get": "get", "delete": "delete", "remove": "delete", "rm": "delete", "del": "delete", "clear": "clear", "help": "help", "exit": "exit", "quit": "exit"}
HELP = """put KEY VALUE   write a row (also: set, update); the value may hold spaces
get KEY         show the newest value, (nil) if there is none
delete KEY      write a tombstone (also: remove, rm, del)
clear           remove all rows, after a question
help            this list
exit            leave (also: quit)"""


def parse(line: Column) -> Column:
    """struct(command, key, value) of a line: at most three parts, the value keeping its spaces.

    Blank lines give null; an unknown command is `unknown`, one without its arguments `usage`.
    """
    parts = F.split(F.trim(line), " ", 3)
    part = lambda i: F.try_element_at(parts, F.lit(i))
    name = F.lower(part(1))
    known = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])[name]
    needs = F.when(known == "put", 3).when(known.isin("get", "delete"), 2).otherwise(1)
    command = F.when(known.isNull(), "unknown").when(F.size(parts) < needs, "usage").otherwise(known)
    return F.when(F.trim(line) != "", F.struct(command.alias("command"), part(2).alias("key"), part(3).alias("value")))


def run_script(script: DataFrame, line_no: str = "line_no", line: str = "line") -> DataFrame:
    """What each get of a script answers: line_no, key and value, null for none.

    The script is one log: a get reads the newest change before it of its key, or since
    the last clear. Nothing after the first exit counts.
    """
    rows = script.select(F.col(line_no).alias("line_no"), parse(F.col(line)).alias("c")).where("c IS NOT NULL").select("line_no", "c.*")
    # One row: the first exit, or null.
    last = rows.where("command = 'exit'").agg(F.min("line_no").alias("_end"))
    rows = rows.join(F.broadcast(last), F.col("_end").isNull() | (F.col("line_no") < F.col("_end"))).drop("_end")
    # A change is seen by gets of its key up to the next clear: the clears before a line say which part it is in.
    rows = running_total(rows, "line_no", F.when(F.col("command") == "clear", 1).otherwise(0), "part")
    change = F.when(F.col("command") == "put", F.col("value")).when(F.col("command") == "delete", "")
    rows = running_last(rows.where("command IN ('put', 'delete', 'get')"), ["key", "part"], "line_no", change, "value")
    return rows.where("command = 'get'").select("line_no", "key", F.when(F.col("value") != "", F.col("value")).alias("value"))


def execute(table: Table, line: str, confirm=input) -> str | None:
    """Carry out one line; returns what it prints, None to end."""
    text = line.strip()
    if not text:
        return ""
    name, *rest = text.split(" ", 2)
    command, began = ALIASES.get(name.lower()), time.perf_counter()
    spent = lambda: f"({(time.perf_counter() - began) * 1e6:.0f} µs)"
    if command == "exit":
        return None
    if command == "help":
        return HELP
    if command == "put":
        if len(rest) < 2:
            return "usage: put <key> <value>"
        table.put(rest[0], rest[1])
        return f"OK {rest[0]} {spent()}"
    if command == "get":
        if not rest:
            return "usage: get <key>"
        value = table.get(rest[0])
        return "(nil)" if value is None else f"{rest[0]} → {value.decode('utf-8', 'replace')}\n  {spent()}"
    if command == "delete":
        if not rest:
            return "usage: delete <key>"
        table.remove(rest[0])
        return f"OK {rest[0]} {spent()}"
    if command == "clear":
        if confirm("All rows will be removed. Go on? [y/N] ").strip().lower() != "y":
            return "Nothing was removed."
        table.clear()
        return "All rows are removed."
    return f"no such command: {name.lower()} (help lists them)"


def main(arguments: list[str]) -> None:
    folder = arguments[0] if arguments else str(Path.home() / ".tidemark")
    spark = SparkSession.builder.appName("tidemark").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    table = Table(spark, folder)
    print(f"tidemark, table {folder} (help lists the commands)")
    while True:
        try:
            said = execute(table, input("tidemark> "))
        except EOFError:
            print()
            return
        except Exception as e:  # a failed command doesn't end the prompt
            said = f"error: {e}"
        if said is None:
            return
        if said:
            print(said)


if __name__ == "__main__":
    main(sys.argv[1:])
