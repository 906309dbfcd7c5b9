"""Operator 10: find secrets by fixed patterns and by inferred token formats.

Base patterns give spans of three kinds.  The values found that way in a bounded sample (`SAMPLE_DOCS`
documents, `SAMPLE_RUNS` distinct values and as many ordinary runs, none over `LONGEST` characters), and
credentials drawn from published formats, are the labelled credentials: for each format a
prefix tree of their character classes is merged into a probabilistic automaton by the ALERGIA
rule (Carrasco and Oncina, 1994): two states are merged if their numbers of endings and of each
successor could, by the Hoeffding bound, come from one distribution, and if all their successors
can be merged too.

All other candidates are scored whole by the likelihood ratio per character of the best format against
the best automaton of ordinary runs: those of the same sample, and runs made by rule that look like
credentials and are none (encoded prose, UUIDs, numbered names), a kind each.  Candidates are the runs of
credential characters that base spans leave free, and where a run is none, its parts between slashes,
dots, plus and equals signs.  A fifth of all labelled runs is held out: the cutoff is the first percentile of
its credentials, so that one in a hundred is missed, or, where that lies below the 99th percentile of its ordinary
runs, halfway between the two.  Candidates from it on are spans of kind ``format``.

Defined cases: null text is empty; repeated rows get equal results; a null doc_id is a value like
any other; an empty table gives no rows; other columns are ignored.  The models are a few kilobytes
and travel with the tasks.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
import uuid
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The base patterns, and the length that a match must have (of group 2 for assign).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "format")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
PART = re.compile(r"[A-Za-z0-9_-]{16,}")

#: Least length of a candidate.
SHORTEST = 16
#: Bounds of the sample that formats and ordinary runs are learned from: documents, distinct labelled values
#: and distinct ordinary runs, and the length of a run that is learned from (longer ones are scored all the same).
SAMPLE_DOCS, SAMPLE_RUNS, LONGEST = 4000, 4000, 256
#: Merging: Hoeffding level; least visits of a state that a test is made on.
ALPHA, LEAST = 0.01, 10
#: Log-likelihood ratio per character from which a candidate is a secret, where a model has no cutoff of its own.
CUTOFF = 0.5

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ALL = _DIGITS + _LOWER + _UPPER
#: Published credential formats as fixed text, alphabet and length of what is drawn, and so on.
FORMATS = {
    "version-control token": ("ghp_", _ALL, 36),
    "fine-grained token": ("github_pat_", _ALL, 22, "_", _ALL, 59),
    "repository token": ("glpat-", _ALL + "_-", 20),
    "payment key": ("sk_live_", _ALL, 24),
    "chat token": ("xoxb-", _DIGITS, 12, "-", _DIGITS, 12, "-", _ALL, 24),
    "map key": ("AIza", _ALL + "_-", 35),
    "package token": ("npm_", _ALL, 36),
    "project key": ("sk-proj-", _ALL + "_-", 48),
    "mail key": ("SG.", _ALL + "_-", 22, ".", _ALL + "_-", 43),
    "web token": ("eyJ", _ALL + "_-", 33, ".eyJ", _ALL + "_-", 77, ".", _ALL + "_-", 43),
    "access key": ("AKIA", _DIGITS + _UPPER, 16),
    "secret key": ("", _ALL + "+/", 40),
}
PER_FORMAT, SEED = 400, 17


def classes(run: str) -> str:
    """A run as character classes: hex letters, other letters, digits; each mark is its own class."""
    return run.translate(_CLASSES)


_CLASSES = str.maketrans({**dict.fromkeys(_DIGITS, "0"), **dict.fromkeys("abcdef", "a"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "z"), **dict.fromkeys(_UPPER, "A")})
ALPHABET = "0azA+/_.=-"


def quads(run: str) -> str:
    """A run as character classes with their place in a group of four: `place` tells it."""
    return "".join(chr(_QUAD + 4 * ALPHABET.index(c) + i % 4) for i, c in enumerate(classes(run)))


def place(symbol: str) -> int:
    """The place in a group of four of a symbol of `quads`; symbols of `classes` have one place."""
    return ord(symbol) % 4 if ord(symbol) >= _QUAD else 0


#: First of the symbols of `quads`, a multiple of four.
_QUAD = 0x400
QUADS = "".join(chr(_QUAD + i) for i in range(4 * len(ALPHABET)))
_SIZES = {"0": 10, "a": 6, "z": 20, "A": 26}


class Automaton:
    """A deterministic probabilistic automaton: per state its visits, endings and counted successors."""

    def __init__(self, samples: Iterable[str], symbols: Callable[[str], str] = classes):
        self.symbols = symbols
        self.visits, self.ends, self.next = [0], [0], [{}]  # next: symbol -> [state, count]
        for word, n in sorted(Counter(map(symbols, samples)).items()):
            self._add(word, n)
        self._merge_all()
        self._log()

    def _add(self, word: str, n: int) -> None:
        s = 0
        self.visits[0] += n
        for c in word:
            edge = self.next[s].get(c)
            if edge is None:
                self.visits.append(0)
                self.ends.append(0)
                self.next.append({})
                edge = self.next[s][c] = [len(self.visits) - 1, 0]
            edge[1] += n
            s = edge[0]
            self.visits[s] += n
        self.ends[s] += n

    def _alike(self, a: int, b: int) -> bool:
        """Whether two states and all that follows them are statistically compatible."""
        todo = [(a, b)]
        while todo:
            x, y = todo.pop()
            n, m = self.visits[x], self.visits[y]
            if min(n, m) < LEAST:
                continue
            bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            if abs(self.ends[x] / n - self.ends[y] / m) > bound:
                return False
            for c in self.next[x].keys() | self.next[y].keys():
                i, j = self.next[x].get(c), self.next[y].get(c)
                if abs((i[1] if i else 0) / n - (j[1] if j else 0) / m) > bound:
                    return False
                if i and j:
                    todo.append((i[0], j[0]))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Add the counts of a subtree to a state and what follows it."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.visits[a] += self.visits[b]
            self.ends[a] += self.ends[b]
            for c, (state, n) in self.next[b].items():
                edge = self.next[a].get(c)
                if edge is None:
                    self.next[a][c] = [state, n]
                else:
                    edge[1] += n
                    todo.append((edge[0], state))

    def _merge_all(self) -> None:
        """Red states are settled; the successors of red states are merged into one or become red."""
        red = [0]
        i = 0
        while i < len(red):
            for c in sorted(self.next[red[i]]):
                state = self.next[red[i]][c][0]
                if state in red:
                    continue
                twin = next((r for r in red if self._alike(r, state)), None)
                if twin is None:
                    red.append(state)
                else:
                    self.next[red[i]][c][0] = twin
                    self._fold(twin, state)
            i += 1
        place = {s: k for k, s in enumerate(red)}
        self.visits, self.ends = [self.visits[s] for s in red], [self.ends[s] for s in red]
        self.next = [{c: (place[t], n) for c, (t, n) in self.next[s].items() if t in place} for s in red]

    def _log(self) -> None:
        """Log probabilities, a half visit added for each symbol so that nothing is impossible.

        A symbol's place follows from the position, so its probability is one among those of its place.
        """
        extra = 0.5
        alphabet = QUADS if self.symbols is quads else ALPHABET
        self.steps, self.last = [], []
        for v, e, nxt in zip(self.visits, self.ends, self.next, strict=True):
            counts = {c: (nxt[c][1] if c in nxt else 0) + extra for c in alphabet}
            places = Counter()
            for c, n in counts.items():
                places[place(c)] += n
            total = v + extra * (len(alphabet) + 1)
            self.last.append(math.log((e + extra) / total))
            goes_on = math.log(1 - (e + extra) / total)
            self.steps.append({c: (nxt[c][0] if c in nxt else 0, math.log(n / places[place(c)]) + goes_on) for c, n in counts.items()})

    def score(self, run: str) -> float:
        """Log likelihood of a run."""
        s, total = 0, 0.0
        steps = self.steps
        for c in self.symbols(run):
            s, p = steps[s][c]
            total += p
        return total + self.last[s]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, sorted by start and kind."""
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def exemplars(seed: int = SEED, each: int = PER_FORMAT) -> dict[str, list[str]]:
    """Labelled credentials drawn from the published formats."""
    rng = random.Random(seed)

    def draw(parts: tuple) -> str:
        return "".join(text + "".join(rng.choices(letters, k=n)) for text, letters, n in zip(parts[::3], parts[1::3], parts[2::3], strict=True))

    return {name: [draw(parts) for _ in range(each)] for name, parts in FORMATS.items()}


#: Kinds of ordinary runs that are written in groups of four characters.
_IN_QUADS = ("encoded prose",)


class Model:
    """An automaton per format and per kind of ordinary run, and the cutoff between them."""

    def __init__(self, credentials: dict[str, list[str]], ordinary: dict[str, list[str]], cutoff: float = CUTOFF):
        self.formats = {name: Automaton(runs) for name, runs in sorted(credentials.items()) if len(runs) >= LEAST}
        self.ordinary = {name: Automaton(runs, quads if name in _IN_QUADS else classes) for name, runs in sorted(ordinary.items()) if runs}
        self.cutoff = cutoff

    def score(self, run: str) -> float:
        """Log-likelihood ratio per character of the best format against the best kind of ordinary run."""
        best = lambda kinds: max((a.score(run) for a in kinds.values()), default=-math.inf)
        return (best(self.formats) - best(self.ordinary)) / (len(run) + 1)


def held_out(run: str) -> bool:
    return zlib.crc32(run.encode()) % 5 == 0


def learn(credentials: dict[str, list[str]], ordinary: dict[str, list[str]]) -> Model:
    """A model of the runs that are not held out, with a cutoff from those that are: formats drawn by rule against all ordinary runs."""
    part = lambda kinds, out: {k: [r for r in runs if held_out(r) == out] for k, runs in kinds.items()}
    model = Model(part(credentials, False), part(ordinary, False))
    drawn = part({k: v for k, v in credentials.items() if k in FORMATS}, True)
    scores = [sorted(model.score(r) for r in {r for runs in kinds.values() for r in runs if len(r) >= SHORTEST}) for kinds in (part(ordinary, True), drawn)]
    if all(scores):
        plain, secret = scores
        most, least = plain[min(len(plain) - 1, len(plain) * 99 // 100)], secret[len(secret) // 100]
        model.cutoff = least if least > most else (most + least) / 2
    return model


def _sample_runs(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A text's labelled values and other runs: lines of kind, tab, run."""
    for series in texts:
        out = []
        for text in series:
            text = text or ""
            found = base_spans(text)
            lines = [("assign", m[2]) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
            lines += [(kind, text[a:b]) for a, b, kind in found if kind != "assign"]
            lines += [("", text[a:b]) for a, b in _free(text, found)]
            out.append([f"{kind}\t{run}" for kind, run in lines if len(run) <= LONGEST])
        yield pd.Series(out)


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Infer the automata from at most ``sample_docs`` documents, the least by hash of id and text."""
    chosen = common.sample_by_hash(docs.select("doc_id", "text"), ["doc_id", "text"], sample_docs)
    lines = F.pandas_udf(_sample_runs, "array<string>")
    runs = common.materialize(chosen.select(F.explode(lines("text")).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n")), "runs")
    ordinary_run = F.col("run").startswith("\t")
    credentials, ordinary = defaultdict(list, exemplars()), ordinary_exemplars()
    for part in (runs.where(~ordinary_run), runs.where(ordinary_run)):
        for run, n in part.orderBy(F.desc("n"), F.xxhash64("run"), "run").limit(SAMPLE_RUNS).collect():
            kind, _, value = run.partition("\t")
            (credentials[kind] if kind else ordinary["runs"]).extend([value] * n)
    return learn(*({k: sorted(v) for k, v in kinds.items()} for kinds in (credentials, ordinary)))


def ordinary_exemplars(seed: int = SEED, each: int = PER_FORMAT) -> dict[str, list[str]]:
    """Runs that are no credentials whatever the sample, by kind: paths, dates, names, constants and rules of marks; and look-alikes."""
    rng = random.Random(seed)
    prose = lambda: rng.choice([" ", " ", ", ", ". ", "\n"]).join(rng.choice([w, w, w.title(), w[: rng.randint(1, 9)]]) for w in rng.choices(_ORDINARY, k=rng.randint(2, 30)))
    name = lambda: "".join(w[: rng.randint(2, 12)].title() for w in rng.choices(_ORDINARY, k=rng.randint(2, 5)))
    return {
        "runs": _plain_exemplars(),
        "encoded prose": [base64.b64encode(prose().encode()).decode() for _ in range(4 * each)],
        "uuid": [str(uuid.UUID(int=rng.getrandbits(128), version=4)) for _ in range(2 * each)],
        "numbered name": [f"{n[0].lower() + n[1:] if rng.random() < 0.3 else n}{rng.choice(['', '_', '-'])}{rng.randrange(10 ** rng.randint(1, 4))}" for n in (name() for _ in range(4 * each))],
    }


def _plain_exemplars() -> list[str]:
    pairs, triples = [*zip(_ORDINARY, _ORDINARY[3:], strict=False)], [*zip(_ORDINARY, _ORDINARY[1:], _ORDINARY[5:], strict=False)]
    words = ["/".join(w) for w in pairs] + ["_".join(w) for w in triples] + ["-".join(w) for w in pairs] + [".".join(w) for w in pairs] + ["".join(w) for w in pairs]
    names = ["".join(x.title() for x in w) for w in triples] + ["_".join(w).upper() for w in triples] + ["".join(w).upper() for w in pairs]
    days = [f"{1990 + i % 40}{mark}{i % 12 + 1:02d}{mark}{i % 28 + 1:02d}" for i in range(84) for mark in "-/"]
    dated = [x for i, day in enumerate(days) for a, b in [pairs[i % len(pairs)]] for x in (f"/{a}/{b}/{day}/{b}.html", f"{day}-{a}-{b}", f"{a}-{b}-{day}", f"{a}_{i}.{i % 10}.{i % 7}", f"/{a}/{day[:7]}/{b}{i}.html")]
    return words + names + dated + [w * k for w in "=-._" for k in range(16, 80)]


#: Plain words, so that ordinary runs are never without a model.
_ORDINARY = (
    "information development international documentation configuration implementation application environment management "
    "communication organization understanding responsibility particularly approximately characteristics representative "
    "department government association production performance experience knowledge education university technology"
).split()


def _free(text: str, base: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """(start, end) of the candidate runs that base spans leave; ``base`` is sorted by start."""
    k, reach = 0, 0  # base spans that begin before the place reached, and their furthest end
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        while at < end:
            while k < len(base) and base[k][0] <= at:
                reach = max(reach, base[k][1])
                k += 1
            if reach > at:
                at = min(reach, end)
                continue
            to = min(end, base[k][0]) if k < len(base) else end
            if to - at >= SHORTEST:
                yield at, to
            at = to


def find_spans(text: str, model: Model, cutoff: float | None = None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans)."""
    base, more = base_spans(text), []
    cutoff = model.cutoff if cutoff is None else cutoff
    for a, b in _free(text, base):
        if model.score(text[a:b]) >= cutoff:
            more.append((a, b, "format"))
        else:
            parts = (m.span() for m in PART.finditer(text, a, b) if m.span() != (a, b))
            more += [(x, y, "format") for x, y in parts if model.score(text[x:y]) >= cutoff]
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _told(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def scan_secrets(docs: DataFrame, model: Model | None = None, cutoff: float | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row of ``docs``."""
    model = model or fit(docs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                base, every = find_spans(text or "", model, cutoff)
                n = Counter(k for _, _, k in base)
                rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(_told(base).encode()).hexdigest(), _told(every)))
            names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            columns = {n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types, strict=True))}
            yield pa.record_batch({"doc_id": batch.column("doc_id")} | columns)

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document of ``documents``: counts of base spans, their digest and all spans."""
    return scan_secrets(common.table(spark, sf_dir, "documents"))
