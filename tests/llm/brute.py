"""Plain versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import defaultdict

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def crc(x):
    return zlib.crc32(str(x).encode())


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def near_duplicates(docs, size=5, percent=80):
    """{doc_id: (n_shingles, component_id)}"""
    sets = {}
    for d, text in docs:
        w = words((text or "").translate(FOLD))
        sets[d] = frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    where = defaultdict(list)
    for d, s in sets.items():
        count = defaultdict(int)
        for g in s:
            for e in where[g]:
                count[e] += 1
            where[g].append(d)
        for e, k in count.items():
            if 100 * k >= percent * (len(s) + len(sets[e]) - k):
                a, b = find(d), find(e)
                root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def substring_dedup(docs, size=35):
    """[(doc_id, n_words, n_removed, kept)] in the order of ``docs``."""
    all_words = [words(t) for _, t in docs]
    count = defaultdict(int)
    for w in all_words:
        for i in range(len(w) - size + 1):
            count[tuple(w[i : i + size])] += 1
    out = []
    for (d, _), w in zip(docs, all_words, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                gone.update(range(i, i + size))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def byte_dedup(docs, size=50):
    """[(doc_id, n_bytes, n_removed, n_spans, kept)] in the order of ``docs``; ids may repeat or be None."""
    big = float("inf")
    data = [(big if d is None else d, (t or "").encode()) for d, t in docs]
    first = {}
    for d, x in data:
        for i in range(len(x) - size + 1):
            w = x[i : i + size]
            first[w] = min(first.get(w, big), d)
    out = []
    for (d, _), (k, x) in zip(docs, data, strict=True):
        gone = bytearray(len(x))
        for i in range(len(x) - size + 1):
            if first[x[i : i + size]] < k:
                gone[i : i + size] = b"\1" * size
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(x), sum(gone), spans, bytes(c for c, g in zip(x, gone, strict=True) if not g)))
    return out


def decontaminate(docs, items, size=10):
    """[(doc_id, n_words, n_hit, items)] in the order of ``docs``."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(FOLD))
    windows = defaultdict(set)
    for item, t in items:
        w = cut(t)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[i : i + size])].add("" if item is None else str(item))
    lengths = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, own = cut(t), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    own |= found
        out.append((d, len(w), len(hit), sorted(own)))
    return out


def chroma_search(rows: list, every: int, most_errors: float, least_overlap: int) -> list:
    """(rec, class_id, fp, matches) of rows (rec, fp): every row against every distinct query, offset by offset."""
    classes: dict = {}
    for rec, fp in rows:
        if fp:
            classes.setdefault(tuple(fp), []).append(rec)
    out = []
    for rec, fp in rows:
        matches = []
        for q, members in classes.items():
            asked = [x for x in members if x is not None and x % every == 0]
            if not fp or not asked or set(asked) == {rec}:
                continue
            votes: dict = {}
            for i, x in enumerate(fp):
                for j, y in enumerate(q):
                    if x == y:
                        votes[i - j] = votes.get(i - j, 0) + 1
            if not votes:
                continue
            off = min(votes, key=lambda o: (-votes[o], abs(o), o))
            both = list(zip(fp[max(off, 0) :], q[max(-off, 0) :], strict=False))
            errors = sum(((x ^ y) & 0xFFFFFFFF).bit_count() for x, y in both)
            if len(both) >= least_overlap and errors <= most_errors * 32 * len(both):
                matches.append((min(asked), len(asked), off, errors, 32 * len(both)))
        known = [x for x in classes.get(tuple(fp or ()), []) if x is not None]
        out.append((rec, min(known) if known else None, fp, sorted(matches)))
    return out


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def fill_in_middle(doc_id, text, seed=42, fim=50, spm=80):
    """(n, form, prefix_chars, middle_chars, output)"""
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= fim:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def cross_alignment(docs, tokenizer, pieces):
    """[(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)] token by token; ``groups`` is None without tokens."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(sorted(set(range(256)) - set(plain)))}
    rows = []
    for d, text in docs:
        a, b = (tokenizer.encode(" " + text, add_special_tokens=False).ids, pieces.encode(text)) if text else ([], [])
        a_bytes = [bytes(byte_of[c] for c in tokenizer.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode() for i in b]
        want = (" " + text).encode() if text else b""
        if not text or b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            rows.append((d, [], [], [], None))
            continue
        ends = []
        for tokens in (a_bytes, b_bytes):
            at, own = 0, {}
            for i, x in enumerate(tokens):
                at += len(x)
                own[at] = i
            ends.append(own)
        links, groups, x, y = [], [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            i, j = ends[0][e], ends[1][e]
            links.append((a[i], b[j]))
            groups.append(",".join(map(str, a[x : i + 1])) + "|" + ",".join(map(str, b[y : j + 1])))
            x, y = i + 1, j + 1
        rows.append((d, a, b, links, ";".join(groups)))
    count: dict = defaultdict(int)
    for r in rows:
        for link in r[3]:
            count[link] += 1
    most: dict = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    return [(d, len(a), len(b), len(k), len(k), sum(count[x] == most[x[1]] for x in k), sum(count[x] for x in k), g) for d, a, b, k, g in rows]
