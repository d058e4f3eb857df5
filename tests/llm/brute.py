"""Plain versions of what the operators define, for small inputs."""

from __future__ import annotations

import collections
import functools
import hashlib
import re

import numpy as np
import regex
import xxhash

SPACE_WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def quality(text):
    text = text or ""
    w = SPACE_WORD.findall(text)
    triples, covered = collections.Counter(zip(w, w[1:], w[2:])), set()
    for i in range(len(w) - 2):
        if triples[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if SPACE_WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@functools.lru_cache(maxsize=4)
def _windows(items, window):
    wins = collections.defaultdict(set)
    for i, t in items:
        w = WORD.findall(lower(t))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[k : k + n])].add(i)
    return wins


def contamination(text, items, window=10):
    """(n_words, n_hit, sorted string ids) for items as (id, text)."""
    wins = _windows(tuple(items), window)
    w, hit, found = WORD.findall(lower(text)), set(), set()
    for n in {len(k) for k in wins}:
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in wins:
                found |= wins[tuple(w[k : k + n])]
                hit |= set(range(k, k + n))
    return len(w), len(hit), sorted(map(str, found))


def fingerprint(text, shingle=3):
    w = SPACE_WORD.findall(lower(text))
    parts = [" ".join(w[i : i + shingle]) for i in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def components(ids, fps, budget=3):
    """id -> smallest id reachable."""
    label = list(range(len(ids)))

    def top(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    fps = np.array(fps, dtype=np.uint64)
    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= budget):
            label[top(i)] = top(i + 1 + int(j))
    low = {}
    for i, x in enumerate(ids):
        low[top(i)] = min(low.get(top(i), x), x)
    return {x: low[top(i)] for i, x in enumerate(ids)}


PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def personal(text):
    """(counts by kind, list of kind:start:end)."""

    def passes(kind, v):
        digits = re.sub("[^0-9]", "", v)
        if kind == "ip":
            return all(int(x) <= 255 for x in v.split("."))
        if kind == "card":
            return 16 <= len(digits) <= 19 and luhn(digits)
        return 8 <= len(digits) <= 15 if kind == "phone" else True

    counts, spans = [], []
    for kind, pattern in PII.items():
        m = [f"{kind}:{x.start()}:{x.end()}" for x in re.finditer(pattern, text or "") if passes(kind, x[0])]
        counts.append(len(m))
        spans += m
    return counts, spans


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def _letters(text):
    return [x.lower() for x in regex.findall(r"\p{L}+", text)]


def _group(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return {"email": value.lower().rpartition("@")[2], "ip": ".".join(value.split(".")[:2]), "card": digits[:6], "phone": digits[:4]}[kind]


def evidence(texts, near=8):
    """(entity, term) -> documents, entity -> documents, from id -> text."""
    both, entity = collections.defaultdict(set), collections.defaultdict(set)
    for i, t in texts.items():
        t = t or ""
        for kind, pattern in PII.items():
            found = list(re.finditer(pattern, t))
            good = [x for x in found if f"{kind}:{x.start()}:{x.end()}" in personal(t)[1]]
            edges = [0, *(y for x in found for y in x.span()), len(t)]
            gaps = [_letters(re.sub(r"\S*[0-9@]\S*", " ", t[a:b])) for a, b in zip(edges[::2], edges[1::2], strict=True)]
            for k, x in enumerate(found):
                if x not in good:
                    continue
                before, after = [w for g in gaps[: k + 1] for w in g][-near:], [w for g in gaps[k + 1 :] for w in g][:near]
                digits = re.sub("[^0-9]", "", x[0])
                for e in (f"{kind}:{x[0].lower() if kind in ('email', 'ip') else digits}", f"{kind} group:{_group(kind, x[0])}"):
                    entity[e].add(i)
                    for w in (*before, *after):
                        both[e, w].add(i)
    return both, entity


def disclosing(texts, unseen=1, generalise=0.9, support=3):
    """(entity, term) -> share of the entity's information, from generalise on, of terms near it in that many different texts."""
    both, entity = evidence(texts)
    n_term = collections.Counter(w for t in texts.values() for w in set(_letters(t or "")))
    out = {}
    for (e, w), docs in both.items():
        if len({texts[i] for i in docs}) < support:
            continue
        own = np.log2(len(texts) / len(entity[e]))
        share = (own - np.log2((max(n_term[w], len(docs)) + unseen) / len(docs))) / own if own > 0 else 0
        if share >= generalise:
            out[e, w] = share
    return out


def all_spans(texts):
    """id -> kind:start:end of entities and of terms that reveal them, joined."""
    both, terms = evidence(texts)[0], collections.defaultdict(set)
    for e, w in disclosing(texts):
        for i in both[e, w]:
            terms[i].add(w)
    return {i: ",".join(personal(t)[1] + [f"term:{x.start()}:{x.end()}" for x in regex.finditer(r"\p{L}+", t or "") if x[0].lower() in terms[i]]) for i, t in texts.items()}


def passages(texts, borders, min_words=34, min_bytes=360):
    """Sorted (id, start, end, n_chunks, run_words, run_bytes, first_id, is_first) of runs of chunks that several texts (not null) hold, for ids from 0."""
    rows = {}
    for i, t in enumerate(texts):
        raw = t.encode()
        at = list(borders(raw))
        rows[i] = [(raw[a:b], len(raw[:a].decode()), len(raw[:b].decode()), b - a, sum(a <= x.start() < b for x in re.finditer(rb"[^\x20\x09-\x0D]+", raw))) for a, b in zip(at, at[1:])]
    holders = collections.defaultdict(set)
    for i, own in rows.items():
        for c in own:
            holders[c[0]].add(i)
    out = []
    for i, own in rows.items():
        runs, last = [], None
        for c in own:
            if len(holders[c[0]]) > 1:
                runs = [*runs, [c]] if last != c[1] else [*runs[:-1], [*runs[-1], c]]
                last = c[2]
        for run in runs:
            size, words = sum(c[3] for c in run), sum(c[4] for c in run)
            first = [min(holders[c[0]]) for c in run]
            if words >= min_words or size >= min_bytes:
                cut = [k for k in range(1, len(run)) if (first[k] == i) != (first[k - 1] == i)]
                for a, b in zip([0, *cut], [*cut, len(run)], strict=True):
                    out.append((i, run[a][1], run[b - 1][2], b - a, words, size, first[a], first[a] == i))
    return sorted(out)


def language(text, languages, words, grams, longest=4):
    """(language, share of likelihood) by words, and n-grams where a word is not known."""
    total = np.zeros(len(languages))
    for w in _letters(text):
        marked = f"^{w}$"
        rows = [words[w]] if w in words else next((r for n in range(longest, 0, -1) if (r := [grams[marked[k : k + n]] for k in range(len(marked) - n + 1) if marked[k : k + n] in grams])), [total * 0])
        total = total + np.mean(rows, axis=0)
    p = np.exp(total - total.max())
    return languages[int(total.argmax())], float(p.max() / p.sum())


def subwords(text, model):
    """Bucket -> count of a text's words, character n-grams (3 and 4, with a space at either end), and repeated words."""
    mask, out = (1 << 64) - 1, collections.Counter()

    def bucket(chars, kind):
        h = 0
        for c in chars:
            h = (h * int(model._BASE) + ord(c) + 1) & mask
        return int(model._bucket(np.array([h], dtype=np.uint64), kind)[0])

    parts = regex.findall(r"[^ \t\n\x0b\x0c\r]+", text)
    for w in parts:
        out[bucket(w, 0)] += 1
        for n in model.GRAMS:
            for k in range(len(w) + 2 - n + 1):
                out[bucket(f" {w} "[k : k + n], n)] += 1
    for m in regex.finditer(r"(?<![^ \t\n\x0b\x0c\r])([^ \t\n\x0b\x0c\r]+)[ \t\n\x0b\x0c\r](?=\1(?![^ \t\n\x0b\x0c\r]))", text):
        out[int(model._bucket(np.array([model.REPEATED], dtype=np.uint64), 1)[0])] += 1
    return dict(out)
