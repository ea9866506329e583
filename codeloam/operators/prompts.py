"""Prompts assembled from rows in a fixed order. Models themselves are injected."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def message_prompts(messages: DataFrame, by: str, order: list[str], label: str = "User", trailer: str = "Assistant:") -> DataFrame:
    """(by, prompt): the messages of each conversation in order, with their roles; roles but system and user are dropped.

    ``messages`` has role and text; NULL texts count as empty. A conversation is one
    group, which its length bounds; ``label`` is what the user is called.
    """
    label = F.when(F.col("role") == "system", "System: ").otherwise(f"{label}: ")
    rows = messages.filter(F.col("role").isin("system", "user")).select(by, F.struct(*order, F.concat(label, F.coalesce("text", F.lit(""))).alias("_line")).alias("_m"))
    blocks = rows.groupBy(by).agg(F.sort_array(F.collect_list("_m")).alias("_all"))
    return blocks.select(by, F.concat_ws("\n\n", F.col("_all._line"), F.lit(trailer) if trailer else F.lit(None)).alias("prompt"))


def file_prompts(ranked: DataFrame, files: DataFrame, cut: int = 800) -> DataFrame:
    """(repository, path, prompt) for ranked (repository, path): facts of the file and the start of its text."""
    from ..functions.text import latest

    def listed(column: str, most: int):
        return F.coalesce(F.nullif(F.array_join(F.slice(F.col(column), 1, most), ", "), F.lit("")), F.lit("none"))

    facts = latest(files, "repository", "path", "extension", F.coalesce(F.col("lines").cast("string"), F.lit("unknown")).alias("lines"), listed("imports", 10).alias("imports"), listed("functions", 15).alias("functions"), listed("classes", 10).alias("classes"), F.substring(F.coalesce("content_preview", F.lit("")), 1, cut).alias("start"))
    text = F.format_string("File: %s\nType: %s, lines: %s\nImports: %s\nFunctions: %s\nClasses: %s\n\n%s", "path", "extension", "lines", "imports", "functions", "classes", "start")
    return facts.join(ranked.select("repository", "path"), ["repository", "path"]).select("repository", "path", text.alias("prompt"))


def batched(prompts: DataFrame, size: int = 3) -> DataFrame:
    """(repository, batch, prompt): the prompts of each repository by path, ``size`` a batch, under numbered heads."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("repository").orderBy("path")) - 1
    rows = prompts.withColumn("k", rank).withColumn("batch", F.floor(F.col("k") / size).cast("long"))
    head = F.format_string("FILE %d: %s", (F.col("k") % size + 1).cast("int"), "prompt")
    return rows.groupBy("repository", "batch").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", head.alias("p")))), lambda x: x.p), "\n\n").alias("prompt"))


def answered(prompts: DataFrame, client: Callable[[str], str | None], column: str = "prompt") -> DataFrame:
    """Adds answer: what the injected client says to each prompt, NULL where it fails. One client a partition."""

    def run(batches: Iterator) -> Iterator:
        for pdf in batches:
            out = []
            for p in pdf[column]:
                try:
                    out.append(client(p))
                except Exception:
                    out.append(None)
            yield pdf.assign(answer=out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema) + ", answer string"
    return prompts.mapInPandas(run, schema)


class Rotation:
    """Keys used in turn; those that were limited are left out. With all limited there is none."""

    def __init__(self, keys: list[str]) -> None:
        self.keys, self.limited, self.used, self._at = list(keys), set(), {k: 0 for k in keys}, 0

    def next(self) -> str | None:
        for _ in self.keys:
            key = self.keys[self._at % len(self.keys)]
            self._at += 1
            if key not in self.limited:
                self.used[key] += 1
                return key
        return None

    def limit(self, key: str) -> None:
        self.limited.add(key)


class Limited(Exception):
    """Raised by a client whose key may not be used any more."""


class Service:
    """A client behind a name: with keys in turn, several tries with growing pauses, and None where all fail."""

    def __init__(self, name: str, call: Callable[[str, str | None], str | None], keys: list[str] | None = None, tries: int = 3, sleep: Callable[[float], None] = time.sleep) -> None:
        self.name, self.call, self.tries, self.sleep = name, call, tries, sleep
        self.keys = Rotation(keys) if keys is not None else None
        self.requests = 0

    @property
    def available(self) -> bool:
        return self.keys is None or bool(set(self.keys.keys) - self.keys.limited)

    def __call__(self, prompt: str) -> str | None:
        self.requests += 1
        for _ in range(len(self.keys.keys) if self.keys else 1):
            key = self.keys.next() if self.keys else None
            if self.keys and key is None:
                return None
            for k in range(self.tries):
                try:
                    return self.call(prompt, key)
                except Limited:
                    if self.keys:
                        self.keys.limit(key)
                    break
                except Exception:
                    if k + 1 < self.tries:
                        self.sleep(2.0**k)
        return None


class Router:
    """Asks clients in order until one answers, and counts who did."""

    def __init__(self, clients: dict[str, Callable[[str], str | None]]) -> None:
        self.clients, self.counts, self.failures = dict(clients), {k: 0 for k in clients}, 0

    def add(self, name: str, client: Callable[[str], str | None]) -> None:
        self.clients[name] = client
        self.counts.setdefault(name, 0)

    def prefer(self, name: str) -> None:
        """Asks ``name`` first from now on."""
        self.clients = {name: self.clients[name]} | self.clients

    def status(self) -> dict:
        """Which clients can be asked, which comes first, and how often each answered."""
        ready = [k for k, c in self.clients.items() if getattr(c, "available", True)]
        return {"services": list(self.clients), "available": ready, "first": ready[0] if ready else None, "requests": sum(self.counts.values()) + self.failures, "answers": dict(self.counts), "failures": self.failures, "ready": bool(ready)}

    def __call__(self, prompt: str) -> str | None:
        for name, client in self.clients.items():
            try:
                answer = client(prompt)
            except Exception:
                answer = None
            if answer:
                self.counts[name] += 1
                return answer
        self.failures += 1
        return None


def keys_of(settings: dict[str, str], name: str, most: int = 4) -> list[str]:
    """The values of name_1 to name_``most`` that are set, in order."""
    return [v for k in range(1, most + 1) if (v := (settings.get(f"{name}_{k}") or "").strip())]


def discovered(settings: dict[str, str], builders: dict[str, Callable[[dict[str, str]], Callable | None]]) -> Router:
    """A router over the services that ``settings`` allow, in the order of ``builders``; one that gives None or fails is left out."""
    clients = {}
    for name, build in builders.items():
        try:
            client = build(settings)
        except Exception:
            client = None
        if client is not None:
            clients[name] = client
    return Router(clients)


class Session:
    """A conversation with what was explored, made and covered in it; each different thing adds ten percent of progress."""

    def __init__(self, history: list[dict] | None = None) -> None:
        self.history = list(history or [])
        self.explored: list[str] = []
        self.exercises: list[str] = []
        self.topics: list[str] = []
        self.level = "beginner"

    def say(self, role: str, content: str) -> None:
        self.history.append({"role": role, "content": content})

    def note(self, file: str | None = None, exercise: str | None = None, topic: str | None = None, level: str | None = None) -> None:
        for value, seen in ((file, self.explored), (exercise, self.exercises), (topic, self.topics)):
            if value and value not in seen:
                seen.append(value)
        self.level = level or self.level

    @property
    def progress(self) -> int:
        return min(100, 10 * (len(self.explored) + len(self.exercises) + len(self.topics)))

    def clear(self) -> None:
        self.history = []
