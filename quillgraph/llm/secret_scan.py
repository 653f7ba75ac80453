"""Secret scan: probabilistic automata inferred from labelled credentials, scoring every candidate.

Training: for each credential format the labelled examples make a prefix tree over character classes
(upper, lower, digit, or the sign itself) whose edges also count the characters seen. Red-blue state
merging then folds a state into an earlier one when a Hoeffding test finds their stopping, class and
character frequencies compatible, and so on down their subtrees; what is left is a deterministic
probabilistic automaton with loops for random bodies and separate states for fixed prefixes.

Scoring: in every run of 16 or more credential characters, each part of 16 or more that begins and ends
at a sign or at the run's ends is a candidate. Its score is the best format's log2 likelihood minus that
of a background of character bigrams, repeats and successions fitted to labelled harmless strings. The automata start at every sign
and of starts that meet in one state only the best goes on, so the time is linear in the run's length.
Of candidates at or above ``threshold`` bits that no base span covers, the best becomes a ``format``
span, then the best that does not overlap it, and so on. Base spans come from fixed patterns and always
stay.

The labelled examples are of two kinds: draws of a seeded generator from published key formats,
``per_format`` each, and the corpus' own: the distinct values that the assign and access patterns find in
all documents, the ``most`` of the least hashes (one more format, if there are enough to merge states).
The models broadcast are a few hundred states. An automaton that has learned a random body accepts it at any
length, so long encoded data reads as a credential too.

Defined results: a null text is empty; an empty text has no spans; texts are read whole; repeated rows
are judged alike; an empty table gives an empty result; other columns are not read. Offsets are code
points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, map_texts

KINDS = ("assign", "access", "hex", "format")
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}+")
LEAST = 16
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}+")
_ENDS = ".-/=+"  # a part neither begins nor ends with these


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of every base match, by start, then kind."""
    out = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


_ALNUM = string.ascii_letters + string.digits
#: Published credential formats as (fixed text, alphabet, length) parts.
FORMATS = {
    "aws": [("AKIA", string.ascii_uppercase + "234567", 16)],
    "github": [("ghp_", _ALNUM, 36)],
    "gitlab": [("glpat-", _ALNUM + "_-", 20)],
    "slack": [("xoxb-", string.digits, 12), ("-", string.digits, 12), ("-", _ALNUM, 24)],
    "stripe": [("sk_live_", _ALNUM, 24)],
    "google": [("AIza", _ALNUM + "_-", 35)],
    "npm": [("npm_", _ALNUM, 36)],
    "jwt": [("eyJ", _ALNUM + "_-", 33), (".eyJ", _ALNUM + "_-", 60), (".", _ALNUM + "_-", 43)],
    "hex_lower": [("", "0123456789abcdef", 40)],
    "hex_upper": [("", "0123456789ABCDEF", 40)],
    "base64": [("", _ALNUM + "+/", 40)],
}


def labelled_credentials(per_format: int = 400, seed: int = 7) -> dict[str, list[str]]:
    rng = random.Random(seed)
    one = lambda parts: "".join(head + "".join(rng.choices(letters, k=n)) for head, letters, n in parts)
    return {label: [one(parts) for _ in range(per_format)] for label, parts in FORMATS.items()}


def labelled_harmless(count: int = 4000, seed: int = 11) -> list[str]:
    """Long words, identifiers, paths, hosts, dates and numbers, by rule from a seed."""
    rng = random.Random(seed)
    syllable = lambda: rng.choice("bcdfghlmnprstvw") + rng.choice("aeiou") + rng.choice(["", "", "n", "r", "s", "t", "nd", "st"])
    word = lambda: "".join(syllable() for _ in range(rng.randint(1, 5)))
    case = lambda w: rng.choice([w, w, w, w.capitalize(), w.upper()])
    number = lambda: str(rng.randint(0, 10 ** rng.randint(1, 12)))
    out = []
    for _ in range(count):
        parts = [case(word()) if rng.random() < 0.8 else number() for _ in range(rng.randint(1, 6))]
        out.append(rng.choice(["", "-", "_", ".", "/", "/", "."]).join(parts) + rng.choice(["", "", "", ".", "..."]))
    return out


#: Long words of four languages, with clusters of letters the rules above do not make.
_LONG_WORDS = """
internationalization responsibilities straightforwardness misunderstandings characteristically incomprehensible acknowledgements knightsbridge lighthousekeeper thoroughbreds
psychotherapeutic strengthlessness counterproductive electromagnetically microarchitecture unconstitutional rhythmically phenomenological bureaucratically schoolteachers
geschwindigkeitsbegrenzung rechtsschutzversicherung bundesverfassungsgericht wissenschaftlerinnen freundschaftsbezeigungen kraftfahrzeughaftpflicht
landwirtschaftlich schifffahrtsgesellschaft krankenversicherungen dampfmaschinenpfeife zwischenmenschlich nahrungsmittelunvertraeglichkeit
anticonstitutionnellement gouvernementaux bouleversements environnementalistes quatrevingtdixneuf chirurgicalement developpements surveillances
desafortunadamente responsabilidades extraordinariamente electroencefalografista desenvolvimiento otorrinolaringologo constitucionalidad agradecimientos quinientosveintiocho guardabosques
"""


def labelled_words() -> list[str]:
    """Long words in lower, upper and title case."""
    return [w for x in _LONG_WORDS.split() for w in (x, x.upper(), x.title())] * 4


def _class(c: str) -> str:
    return "A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" else "0" if "0" <= c <= "9" else c


class _State:
    __slots__ = ("count", "stop", "edges", "chars")

    def __init__(self):
        self.count, self.stop, self.edges, self.chars = 0, 0, {}, {}


class Automaton:
    """A deterministic probabilistic automaton over character classes with character emissions."""

    def __init__(self, examples: list[str], alpha: float = 0.01, least: int = 20):
        self.alpha, self.least = alpha, least
        self.root = _State()
        for text in examples:
            state = self.root
            state.count += 1
            for c in text:
                k = _class(c)
                state.chars.setdefault(k, Counter())[c] += 1
                state = state.edges.setdefault(k, _State())
                state.count += 1
            state.stop += 1
        self._merge()

    def _differ(self, x: int, n: int, y: int, m: int) -> bool:
        bound = math.sqrt(0.5 * math.log(2 / self.alpha)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        return abs(x / n - y / m) > bound

    def _compatible(self, p: _State, q: _State) -> bool:
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            if p is q or p.count < self.least or q.count < self.least:
                continue
            if self._differ(p.stop, p.count, q.stop, q.count):
                return False
            for k in {*p.edges, *q.edges}:
                a, b = p.chars.get(k, Counter()), q.chars.get(k, Counter())
                if self._differ(a.total(), p.count, b.total(), q.count):
                    return False
                if any(self._differ(a[c], p.count, b[c], q.count) for c in {*a, *b}):
                    return False
                if k in p.edges and k in q.edges:
                    stack.append((p.edges[k], q.edges[k]))
        return True

    def _fold(self, p: _State, q: _State) -> None:
        """Add the tree ``q`` to ``p``; where both have an edge their targets fold too."""
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            p.count += q.count
            p.stop += q.stop
            for k, chars in q.chars.items():
                p.chars.setdefault(k, Counter()).update(chars)
            for k, target in q.edges.items():
                if k in p.edges:
                    stack.append((p.edges[k], target))
                else:
                    p.edges[k] = target

    def _merge(self) -> None:
        red = [self.root]
        while True:
            known = {id(s) for s in red}
            blue = [(s, k) for s in red for k, t in s.edges.items() if id(t) not in known]
            if not blue:
                break
            parent, k = max(blue, key=lambda x: x[0].edges[x[1]].count)
            state = parent.edges[k]
            for candidate in reversed(red):
                if candidate is not self.root and self._compatible(candidate, state):
                    parent.edges[k] = candidate
                    self._fold(candidate, state)
                    break
            else:
                red.append(state)
        self.states = len(red)
        number = {id(s): i for i, s in enumerate(red)}
        self.table = []
        for s in red:
            total = s.count + 1.0
            step = {}
            for k, chars in s.chars.items():
                size = {"A": 26, "a": 26, "0": 10}.get(k, 1)
                for c in {"A": string.ascii_uppercase, "a": string.ascii_lowercase, "0": string.digits}.get(k, k):
                    seen = (chars[c] + 0.05) / (chars.total() + 0.05 * size) * chars.total() / total
                    step[c] = (math.log2(seen), number[id(s.edges[k])])
            self.table.append((step, math.log2((s.stop + 0.01) / total)))
        del self.root

    def score(self, text: str) -> float:
        """log2 of the probability of the whole text; minus infinity where an edge is missing."""
        at, total = 0, 0.0
        for c in text:
            found = self.table[at][0].get(c)
            if found is None:
                return -math.inf
            total += found[0]
            at = found[1]
        return total + self.table[at][1]


class Background:
    """A smoothed character-bigram model of harmless strings, mixed with repeated and successive characters."""

    REPEAT, NEXT = 0.08, 0.06

    def __init__(self, examples: list[str]):
        letters = _ALNUM + "+/_.=-"
        pairs, firsts = Counter(), Counter()
        for text in examples:
            for a, b in zip("^" + text, text):
                pairs[a, b] += 1
                firsts[a] += 1
        singles = Counter("".join(examples))
        total = singles.total()
        base = {b: (singles[b] + 1) / (total + len(letters)) for b in letters}
        learned = lambda a, b: (pairs[a, b] + 8 * base[b]) / (firsts[a] + 8)
        filler = lambda a, b: self.REPEAT * (a == b) + self.NEXT * (ord(b) == ord(a) + 1)
        self.step = {(a, b): math.log2((1 - self.REPEAT - self.NEXT) * learned(a, b) + filler(a, b)) for a in "^" + letters for b in letters}

    def score(self, text: str) -> float:
        step = self.step
        return sum(step[p] for p in zip("^" + text, text))


class SecretModel:
    def __init__(self, credentials: dict[str, list[str]] | None = None, harmless: list[str] | None = None, threshold: float = 24.0):
        self.automata = {k: Automaton(v) for k, v in (credentials or labelled_credentials()).items()}
        self.background = Background(harmless or labelled_harmless() + labelled_words())
        self.threshold = threshold
        self.steps, self.stops, self.roots = [], [], []  # the states of all automata, numbered through
        for a in self.automata.values():
            first = len(self.steps)
            self.roots.append(first)
            self.steps += [{c: (seen, first + at) for c, (seen, at) in step.items()} for step, _ in a.table]
            self.stops += [stop for _, stop in a.table]

    def score(self, text: str) -> tuple[float, str]:
        """Log2 odds of the best format against the background, and that format."""
        best, label = max((a.score(text), k) for k, a in self.automata.items())
        return best - self.background.score(text), label

    def parts(self, run: str) -> list[tuple[float, int, int]]:
        """(score, start, end) of parts at or above the threshold: for every end and state the best start."""
        background, steps, stops = self.background.step, self.steps, self.stops
        young: list[tuple[int, float, int]] = []  # (state, score, start) of parts too short yet
        old: dict[int, tuple[float, int]] = {}
        out, before = [], "^"
        for j, c in enumerate(run):
            if young or old:
                harmless, moved, kept = background[before, c], {}, []
                for state, (score, i) in old.items():
                    if found := steps[state].get(c):
                        new = (score + found[0] - harmless, i)
                        if found[1] not in moved or new > moved[found[1]]:
                            moved[found[1]] = new
                for state, score, i in young:
                    if found := steps[state].get(c):
                        new = (score + found[0] - harmless, i)
                        if j + 1 - i < LEAST:
                            kept.append((found[1], *new))
                        elif found[1] not in moved or new > moved[found[1]]:
                            moved[found[1]] = new
                young, old = kept, moved
            if c not in _ENDS:
                if not before.isalnum() and len(run) - j >= LEAST:
                    harmless = background["^", c]
                    young += [(found[1], found[0] - harmless, j) for root in self.roots if (found := steps[root].get(c))]
                if old and not run[j + 1 : j + 2].isalnum():
                    out += [(score + stops[state], i, j + 1) for state, (score, i) in old.items() if score + stops[state] >= self.threshold]
            before = c
        return out

    def spans(self, text: str) -> tuple[list, list]:
        """Base spans, and base plus learned spans, by start, then kind."""
        base = base_spans(text)
        starts = [a for a, _, _ in base]
        reach = [*accumulate((b for _, _, b in base), max)]
        added = []
        for m in _CANDIDATE.finditer(text):
            taken: list[tuple[int, int]] = []
            for _, a, b in sorted(self.parts(m[0]), key=lambda x: (-x[0], x[1], x[2])):
                a, b = m.start() + a, m.start() + b
                at = bisect_right(starts, a)
                if at and reach[at - 1] >= b:
                    continue
                k = bisect_right(taken, (a, b))
                if (k == 0 or taken[k - 1][1] <= a) and (k == len(taken) or b <= taken[k][0]):
                    taken.insert(k, (a, b))
            added += [(a, 3, b) for a, b in taken]
        return base, sorted(base + added)


def show(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def corpus_credentials(df: DataFrame, text: str = "text", most: int = 2000, least: int = 40) -> dict[str, list[str]]:
    """Labelled examples from the corpus: distinct values of 16 or more characters that the assign and access
    patterns find, at most ``most`` by hash; none if there are fewer than ``least``."""
    value = lambda pattern, group: F.regexp_extract_all(F.col(f"`{text}`").cast("string"), F.lit(pattern), F.lit(group))
    names = "password|passwd|secret|token|api_?key"
    found = F.concat(value(rf"""(?i:{names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{{{LEAST},}})""", 1), value("(AKIA[A-Z0-9]{16,})", 1))
    values = df.select(F.explode(found).alias("v")).distinct().orderBy(F.xxhash64("v"), "v").limit(most).collect()
    examples = [v for r in values if len(v := r["v"].strip(_ENDS)) >= LEAST]
    return {"corpus": examples} if len(examples) >= least else {}


def scan_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", model: SecretModel | None = None) -> DataFrame:
    """Counts by kind, a digest of the base spans, all spans and the number of learned ones."""
    shared = df.sparkSession.sparkContext.broadcast(model or SecretModel(labelled_credentials() | corpus_credentials(df, text)))

    def row(t: str) -> tuple:
        base, every = shared.value.spans(t)
        count = Counter(k for _, k, _ in every)
        return count[0], count[1], count[2], hashlib.sha256(show(base).encode()).hexdigest(), show(every), count[3]

    return map_texts(df, [key], text, row, "n_assign long,n_access long,n_hex long,base_sha256 string,spans string,n_format long")


def op1_secret_scan(spark, sf_dir) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))
