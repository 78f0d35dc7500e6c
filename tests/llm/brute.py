"""Plain versions of the operators, for small inputs."""

import re
from collections import defaultdict

import numpy as np
import xxhash

ODD_TEXTS = [
    None, "", " ", "\n\n\n", "one", "Été été Kİ kelvin", "a\tb\x0bc\x1fd e", "x" * 3000,
    "<|endoftext|> in <|startoftext|>text<|endoftext|>", "🟠🟠 emoji 日本語 ñandú", "tail ́combining  ",
    "Line one stands here\nLine two stands here\nLine three stands here\nLine four stands here",
    "Line one stands here\nLine two stands here\nLine three stands here\nLine four stands here",
]
# Columns whose names the operators use themselves.
CLASHING = ("row", "m", "votes", "hits", "items", "id", "kept", "n_words", "text_hash", "fingerprint", "component",
            "number", "runs", "found", "ids", "quality", "host", "path", "data", "spans", "lang_pred", "doc_ID2")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, rows):
    """(doc_id, text) rows as documents with clashing columns."""
    full = [(i, t, "en", "s", None if t is None else len(t)) + tuple("clash" for _ in CLASHING) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA + "".join(f", `{c}` string" for c in CLASHING))


def odd_documents(spark):
    """Odd texts, a very long one, repeated rows, repeated ids with other texts, null ids."""
    rows = list(enumerate(ODD_TEXTS)) + [(50, "word " * 60_000), (3, "\n\n\n"), (4, "another text"), (None, "no id"), (None, None)]
    return documents(spark, rows)


def quality_metrics(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", text or "") if w]
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    places = defaultdict(list)
    for i in range(len(words) - 2):
        places[tuple(words[i : i + 3])].append(i)
    repeated = {j for found in places.values() if len(found) > 1 for i in found for j in (i, i + 1, i + 2)}
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)),
        "n_symbols": sum((text or "").count(c) for c in "#*$%&|<>"),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(repeated), "n_lines": len(lines),
        "n_upper": sum("A" <= c <= "Z" for c in text or ""), "n_shouts": (text or "").count("!"),
        "n_symbol_lines": sum(any(c in "#*$%&|<>" for c in x) for x in lines),
    }


def line_dedup(rows):
    """Kept text, lines and removed lines of (id, text) rows with unique ids.

    Runs of three lines, or of one or two with 50 words, that any earlier place has go.
    """
    seen, out = set(), {}
    for i, text in sorted(rows):
        parts = (text or "").split("\n")
        worded = [n for n, x in enumerate(parts) if re.search("[^\x20\x09-\x0d]", x)]
        gone = set()
        for at in range(len(worded)):
            for n in (1, 2, 3):
                run = tuple(parts[p] for p in worded[at : at + n])
                n_words = sum(len([w for w in re.split("[\x20\x09-\x0d]+", x) if w]) for x in run)
                if len(run) == n and (n == 3 or n_words >= 50):
                    gone.update(worded[at : at + n] if run in seen else [])
                    seen.add(run)
        out[i] = ("\n".join(x for n, x in enumerate(parts) if n not in gone) if gone else text, len(worded), len(gone))
    return out


def simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(fingerprints, bits=3):
    """Smallest index reachable over links of at most so many bits, for each fingerprint."""
    values = np.array(fingerprints, np.uint64)
    label = list(range(len(values)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(values)):
        for j in np.nonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= bits)[0] + i + 1:
            a, b = sorted((find(i), find(int(j))))
            label[b] = a
    return [find(i) for i in range(len(values))]


def ascii_words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lowered)


def decontaminated(text, items, window=10):
    """(words, hit words, item ids found) of a text."""
    words = ascii_words(text)
    hit, found = set(), set()
    for item, benchmark in items:
        own = ascii_words(benchmark)
        size = min(window, len(own))
        for s in range(len(own) - size + 1) if own else ():
            for p in range(len(words) - size + 1):
                if words[p : p + size] == own[s : s + size]:
                    hit.update(range(p, p + size))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


def substring_dedup(rows, length=50):
    """(bytes, removed, runs, kept) of (id, text) rows."""
    first = {}
    for i, text in rows:
        data = (text or "").encode()
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data) + 1, bool)
        for p in range(len(data) - length + 1):
            if first[data[p : p + length]] < i:
                gone[p : p + length] = True
        runs = int((gone[1:] & ~gone[:-1]).sum() + (len(data) > 0 and gone[0]))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((i, len(data), int(gone[: len(data)].sum()), runs, kept))
    return out
