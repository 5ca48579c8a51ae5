"""Grammar inference: probabilistic automata from sample strings by state merging.

A prefix tree holds the counts of the samples. States are then merged where
two of them are statistically compatible: their ending and branching
frequencies differ by no more than Hoeffding bounds allow, and so do those of
their successors. What is left is a small automaton that gives a probability
to every string. All of this is for bounded samples and runs where it is called.

Where a format's characters are random, a tree over their classes thins out
before any two states can be told apart, and all would merge into one.
``infer_by_place`` therefore merges in two passes: first states of the same
depth, from the start on, so that counts pool before they are tested again,
and then states of different depths. Classes are compared one by one and in
groups, so that small samples can still be told apart by coarse differences.
What is left keeps lengths, separators and alphabets by place.
"""

from __future__ import annotations

import math
from collections import deque

#: Symbols: classes of characters, each with its members.
CLASSES = {"d": "0123456789", "h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "H": "ABCDEF", "U": "GHIJKLMNOPQRSTUVWXYZ", "b": "+/", "e": "=", "m": "-", "u": "_", "p": "."}
OTHER = "o"
#: Character sets that formats are told apart by, as classes.
CHARSETS = {"digits": "d", "hex": "dh", "upper hex": "dH", "lower": "dhl", "upper": "dHU", "letters and digits": "dhlHU", "base64": "dhlHUbe"}
SYMBOLS = "".join(CLASSES) + OTHER
_TO_CLASS = {ord(c): k for k, members in CLASSES.items() for c in members}


class _Symbols(dict):
    def __missing__(self, key):
        return ord(OTHER)


_TABLE = _Symbols({k: ord(v) for k, v in _TO_CLASS.items()})


def symbols(text: str) -> str:
    """The string with each character replaced by its class."""
    return text.translate(_TABLE)


class Automaton:
    """States 0..n-1, 0 the start; ``step[q]`` maps a symbol to (next state, log probability), ``end[q]`` is the log probability of ending there; an unseen symbol leads to ``onward[q]``, by default q itself."""

    def __init__(self, step: list[dict[str, tuple[int, float]]], end: list[float], unseen: list[float], onward: list[int] | None = None):
        self.step, self.end, self.unseen = step, end, unseen
        self.onward = list(range(len(step))) if onward is None else onward

    def log_likelihood(self, text: str) -> float:
        """Natural log probability of the string's class sequence; an unseen move has a smoothed price."""
        state, total = 0, 0.0
        for symbol in symbols(text):
            move = self.step[state].get(symbol)
            if move is None:
                total += self.unseen[state]
                state = self.onward[state]
            else:
                state = move[0]
                total += move[1]
        return total + self.end[state]

    def per_symbol(self, text: str) -> float:
        return self.log_likelihood(text) / (len(text) + 1)


def infer(samples: list[str], alpha: float = 0.05, fewest: int = 8, smoothing: float = 0.1) -> Automaton:
    """The automaton that state merging finds for these strings.

    ``alpha``: confidence of the Hoeffding tests; states that fewer than
    ``fewest`` samples pass have no test of their own. Deterministic for a
    sorted sample. No sample: one state that gives every symbol the same chance.
    """
    moves: list[dict[str, int]] = [{}]
    count: list[dict[str, int]] = [{}]
    passed, ended = [0], [0]
    for text in sorted(samples):
        q = 0
        passed[0] += 1
        for s in symbols(text):
            if s not in moves[q]:
                moves[q][s] = len(moves)
                moves.append({})
                count.append({})
                passed.append(0)
                ended.append(0)
            count[q][s] = count[q].get(s, 0) + 1
            q = moves[q][s]
            passed[q] += 1
        ended[q] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def apart(x: int, n: int, y: int, m: int) -> bool:
        return abs(x / n - y / m) > bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def compatible(a: int, b: int) -> bool:
        waiting = [(a, b)]
        while waiting:
            a, b = waiting.pop()
            n, m = passed[a], passed[b]
            if n < fewest or m < fewest:
                continue
            if apart(ended[a], n, ended[b], m):
                return False
            for s in count[a].keys() | count[b].keys():
                if apart(count[a].get(s, 0), n, count[b].get(s, 0), m):
                    return False
                if s in moves[a] and s in moves[b]:
                    waiting.append((moves[a][s], moves[b][s]))
        return True

    def fold(a: int, b: int) -> None:
        """Adds the tree below b to state a."""
        waiting = [(a, b)]
        while waiting:
            a, b = waiting.pop()
            passed[a] += passed[b]
            ended[a] += ended[b]
            for s, below in moves[b].items():
                count[a][s] = count[a].get(s, 0) + count[b][s]
                if s in moves[a]:
                    waiting.append((moves[a][s], below))
                else:
                    moves[a][s] = below

    kept, fringe = [0], deque((0, s) for s in sorted(moves[0]))
    known = {0}
    while fringe:
        parent, s = fringe.popleft()
        q = moves[parent][s]
        if q in known:
            continue
        target = next((r for r in kept if compatible(r, q)), None)
        if target is None:
            kept.append(q)
            known.add(q)
            fringe.extend((q, x) for x in sorted(moves[q]))
        else:
            moves[parent][s] = target
            fold(target, q)
            fringe.extend((r, x) for r in kept for x in sorted(moves[r]) if moves[r][x] not in known)
    number = {q: i for i, q in enumerate(kept)}
    step, end, unseen = [], [], []
    for q in kept:
        total = passed[q] + smoothing * (len(SYMBOLS) + 1)
        step.append({s: (number[t], math.log((count[q][s] + smoothing) / total)) for s, t in moves[q].items() if t in number})
        end.append(math.log((ended[q] + smoothing) / total))
        unseen.append(math.log(smoothing / total))
    return Automaton(step, end, unseen)


#: Groups of classes that are compared as one: digits, small letters, capitals, marks.
COARSE = ("d", "hl", "HU", "bemup" + OTHER)


def infer_by_place(samples: list[str], alpha: float = 0.05, fewest: int = 8, smoothing: float = 0.1) -> Automaton:
    """The automaton of strings whose characters are random but whose places mean something.

    Layer by layer from the start, compatible states of the same depth merge,
    those below one parent first, the most frequent first. Then states of
    different depths merge where they are compatible, nearest depths first. A
    state that fewer than ``fewest`` samples pass is compatible with all.
    Tests are Hoeffding's on the share that ends, on each class and on each
    group of COARSE, of the two states and of all that follows them alike.
    An unseen symbol goes on to where most samples go, so that the places after
    it stay where they are. No sample: one state that gives every symbol the
    same chance.
    """
    moves: list[dict[str, int]] = [{}]
    count: list[dict[str, int]] = [{}]
    passed, ended, depth = [0], [0], [0]
    for text in sorted(samples):
        q = 0
        passed[0] += 1
        for s in symbols(text):
            if s not in moves[q]:
                moves[q][s] = len(moves)
                moves.append({})
                count.append({})
                passed.append(0)
                ended.append(0)
                depth.append(depth[q] + 1)
            count[q][s] = count[q].get(s, 0) + 1
            q = moves[q][s]
            passed[q] += 1
        ended[q] += 1
    into = list(range(len(moves)))
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def at(q: int) -> int:
        while into[q] != q:
            into[q] = into[into[q]]
            q = into[q]
        return q

    def differ(a: int, b: int) -> bool:
        n, m = passed[a], passed[b]
        limit = bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))
        if abs(ended[a] / n - ended[b] / m) > limit:
            return True
        x, y = count[a], count[b]
        if any(abs(x.get(s, 0) / n - y.get(s, 0) / m) > limit for s in x.keys() | y.keys()):
            return True
        return any(abs(sum(x.get(s, 0) for s in group) / n - sum(y.get(s, 0) for s in group) / m) > limit for group in COARSE)

    def compatible(a: int, b: int) -> bool:
        waiting, met = [(at(a), at(b))], set()
        while waiting:
            a, b = pair = waiting.pop()
            if a == b or pair in met or passed[a] < fewest or passed[b] < fewest:
                continue
            met.add(pair)
            if differ(a, b):
                return False
            waiting.extend((at(moves[a][s]), at(moves[b][s])) for s in moves[a].keys() & moves[b].keys())
        return True

    def merge(a: int, b: int) -> None:
        """Makes b one with a, and what follows them by the same symbols."""
        waiting = [(a, b)]
        while waiting:
            a, b = map(at, waiting.pop())
            if a == b:
                continue
            into[b] = a
            passed[a] += passed[b]
            ended[a] += ended[b]
            for s, below in moves[b].items():
                count[a][s] = count[a].get(s, 0) + count[b][s]
                if s in moves[a]:
                    waiting.append((moves[a][s], below))
                else:
                    moves[a][s] = below

    layer = [0]
    while layer:
        below = {at(q): parent for parent in layer for _, q in sorted(moves[parent].items())}
        groups: list[tuple[int, int]] = []
        for q in sorted(below, key=lambda q: (-passed[q], q)):
            near = sorted(groups, key=lambda g: g[1] != below[q])
            target = next((g for g, _ in near if compatible(g, q)), None)
            if target is None:
                groups.append((q, below[q]))
            else:
                merge(target, q)
        layer = [g for g, _ in groups]

    kept, fringe = [0], [0]
    while fringe:
        fringe = sorted({at(q) for r in kept for q in moves[at(r)].values()} - {at(r) for r in kept}, key=lambda q: (depth[q], q))
        if fringe:
            q = fringe[0]
            target = next((r for r in sorted(kept, key=lambda r: (abs(depth[r] - depth[q]), r)) if compatible(r, q)), None)
            if target is None:
                kept.append(q)
            else:
                merge(target, q)
                kept = sorted({at(r) for r in kept})
    number = {q: i for i, q in enumerate(sorted(kept, key=lambda q: (q != at(0), q)))}
    step, end, unseen, onward = [], [], [], []
    for q in number:
        total = passed[q] + smoothing * (len(SYMBOLS) + 1)
        step.append({s: (number[at(t)], math.log((count[q][s] + smoothing) / total)) for s, t in moves[q].items()})
        end.append(math.log((ended[q] + smoothing) / total))
        unseen.append(math.log(smoothing / total))
        reached: dict[int, int] = {}
        for s, t in moves[q].items():
            reached[number[at(t)]] = reached.get(number[at(t)], 0) + count[q][s]
        onward.append(max(reached, key=lambda t: (reached[t], -t)) if reached else number[q])
    return Automaton(step, end, unseen, onward)


def class_sizes() -> dict[str, int]:
    return {k: len(v) for k, v in CLASSES.items()} | {OTHER: 30}


class Format:
    """One format of credentials: a fixed beginning, and an automaton over the classes of what follows, characters of a class being equally likely.

    A quarter of the examples is held out; a string is of the format if it
    begins like it and the likelihood of its classes, a character, is at most
    ``slack`` nats below the least of theirs. Formats with fewer than eight examples hold none
    out.
    """

    def __init__(self, samples: list[str], slack: float = 0.3):
        samples = sorted(samples)
        held = samples[3::4] if len(samples) >= 8 else samples
        fitted = [s for i, s in enumerate(samples) if i % 4 != 3] if len(samples) >= 8 else samples
        low, high = samples[0], samples[-1]
        self.head = low[: next((i for i, (a, b) in enumerate(zip(low, high)) if a != b), 0)] if len(samples) > 1 else ""
        self.automaton = infer_by_place([s[len(self.head) :] for s in fitted])
        self.share = {c: math.log(n) for c, n in class_sizes().items()}
        self.floor = min(map(self.of_classes, held)) - slack

    def of_classes(self, text: str) -> float:
        """Natural log probability of a string's classes, a character; -inf if the string begins otherwise."""
        return self.automaton.log_likelihood(text[len(self.head) :]) / (len(text) + 1) if text.startswith(self.head) else -math.inf

    def fits(self, text: str) -> bool:
        return self.of_classes(text) >= self.floor

    def per_symbol(self, text: str) -> float:
        """Natural log probability of its characters, a character; -inf if the string begins otherwise."""
        return self.of_classes(text) - sum(map(self.share.__getitem__, symbols(text[len(self.head) :]))) / (len(text) + 1)


class Ordinary:
    """Likelihood of ordinary words, character by character: an automaton over classes, with the characters of a class equally likely."""

    def __init__(self, samples: list[str]):
        self.automaton = infer(samples)
        self.share = {c: math.log(n) for c, n in class_sizes().items()}

    def per_symbol(self, text: str) -> float:
        return (self.automaton.log_likelihood(text) - sum(map(self.share.__getitem__, symbols(text)))) / (len(text) + 1)


def grouped(samples: list[str], least: int = 8, share: float = 0.02, head: int = 4) -> dict[str, list[str]]:
    """The samples by format: those that share their first characters with many others, the rest by the characters that they hold."""
    heads: dict[str, int] = {}
    for s in samples:
        heads[s[:head]] = heads.get(s[:head], 0) + 1
    out: dict[str, list[str]] = {}
    for s in samples:
        if heads[s[:head]] >= max(least, share * len(samples)):
            key = f"head {s[:head]}"
        else:
            held = set(symbols(s))
            key = next((name for name, kinds in CHARSETS.items() if held <= set(kinds)), "any")
        out.setdefault(key, []).append(s)
    return out
