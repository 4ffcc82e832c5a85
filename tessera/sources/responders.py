"""What answers service calls: functions of parameters, HTTP, or tables joined on the parameters.

A responder takes calls (call_id, service, url, params) and gives (call_id, status, body, error). A failed
call is a row with its error, never a failed job.
"""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import shared_folder, ship_code

SCHEMA = "call_id string, status int, body string, error string"


def full_url(url: str, params: dict[str, str]) -> str:
    """Address and parameters in the order of their names, all percent-encoded."""
    if not params:
        return url
    pairs = "&".join(f"{quote(k, safe='')}={quote(str(v), safe='')}" for k, v in sorted(params.items()))
    return f"{url}{'&' if '?' in url else '?'}{pairs}"


def http_get(url: str, timeout: float = 10.0) -> tuple[int, str | None]:
    """Status and body; the body of anything but 200 is none."""
    if not url.startswith(("http://", "https://")):
        raise ValueError(f"not a web address: {url}")
    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:
            return r.status, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace") if r.status == 200 else None
    except urllib.error.HTTPError as e:
        return e.code, None


class Log:
    """Answers by call in a folder that driver and executors share. A file is there whole or not at all, so a task that is
    run again finds what it or another one was told before, and asks for the rest only."""

    def __init__(self, folder: str):
        self.folder = re.sub(r"^file:/+", "file:///", folder)
        pyarrow.fs.FileSystem.from_uri(self.folder)  # fails here rather than in tasks

    def _place(self):
        return pyarrow.fs.FileSystem.from_uri(self.folder)

    def found(self, calls: list[str]) -> dict[str, list]:
        fs, base = self._place()
        infos = fs.get_file_info([f"{base}/{c}" for c in calls])
        return {c: json.loads(fs.open_input_stream(i.path).read()) for c, i in zip(calls, infos) if i.type == pyarrow.fs.FileType.File}

    def keep(self, call: str, answer: tuple) -> None:
        fs, base = self._place()
        fs.create_dir(base, recursive=True)
        own = f"{base}/.{call}-{uuid.uuid4().hex}"
        with fs.open_output_stream(own) as f:
            f.write(json.dumps(answer).encode())
        fs.move(own, f"{base}/{call}")


#: Statuses after which a source may answer later.
LATER = (408, 425, 429, 500, 502, 503, 504)


class Http:
    """get(url) -> (status, body), on the executors; calls are spread over `parallel` tasks, of which no more than per_host
    ask one host at a time. What fails, or answers that it may do better later, is asked up to `tries` times, with waits that
    double from `wait` seconds on. A call that was answered, or given up, is not asked again if its task is."""

    def __init__(self, get: Callable[[str], tuple[int, str | None]] = http_get, parallel: int = 16, per_host: int = 4, tries: int = 1, wait: float = 0.5):
        self.get, self.parallel, self.per_host, self.tries, self.wait = get, parallel, per_host, tries, wait

    def answer(self, calls: DataFrame) -> DataFrame:
        ship_code(calls.sparkSession)
        get, join, tries, wait = self.get, full_url, self.tries, self.wait
        log = Log(f"{shared_folder(calls.sparkSession)}/calls-{uuid.uuid4().hex}")

        def ask(url: str) -> tuple:
            out = (None, None, None)
            for k in range(tries):
                if k:
                    time.sleep(wait * 2 ** (k - 1))
                try:
                    status, body = get(url)
                    out = (status, body, None if status == 200 else f"status {status}")
                    if status not in LATER:
                        break
                except Exception as e:  # a source that fails leaves a row, not a failed job
                    out = (None, None, f"{type(e).__name__}: {e}")
            return out

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows, known = [], log.found(list(pdf.call_id))
                for call, url, params in zip(pdf.call_id, pdf.url, pdf.params):
                    if call not in known:
                        known[call] = ask(join(url, dict(params or {})))
                        log.keep(call, known[call])
                    rows.append((call, *known[call]))
                yield pd.DataFrame(rows, columns=["call_id", "status", "body", "error"]).astype({"status": "Int32"})

        # calls of one host and lane follow each other in one task
        host = F.regexp_extract("url", "^[a-zA-Z]+://([^/?#]*)", 1)
        lane = F.pmod(F.xxhash64("call_id"), F.lit(self.per_host))
        return calls.select("call_id", "url", "params").repartition(self.parallel, host, lane).mapInPandas(run, SCHEMA)


class Tables:
    """Bodies by service from DataFrames: make(calls) -> (call_id, body), a join on the parameters."""

    def __init__(self, make: dict[str, Callable[[DataFrame], DataFrame]]):
        self.make = make

    def answer(self, calls: DataFrame) -> DataFrame:
        out = None
        for service, f in self.make.items():
            part = f(calls.where(F.col("service") == service)).select("call_id", F.lit(200).alias("status"), "body", F.lit(None).cast("string").alias("error"))
            out = part if out is None else out.unionByName(part)
        return out


class Files:
    """Documents of any size of services without inputs, read from files element by element (see extract.elements);
    other services are answered by `rest`."""

    def __init__(self, paths: dict[str, str], rest=None):
        self.paths, self.rest = paths, rest

    def answer(self, calls: DataFrame) -> DataFrame:
        here = F.col("service").isin(list(self.paths))
        # what the call gives is read by the extractor
        own = calls.where(here).select("call_id", F.lit(200).alias("status"), F.lit("").alias("body"), F.lit(None).cast("string").alias("error"))
        return own if self.rest is None else own.unionByName(self.rest.answer(calls.where(~here)))
