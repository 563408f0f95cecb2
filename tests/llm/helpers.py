"""Small odd tables and brute-force counterparts for the tests of the operators."""

from collections import Counter, defaultdict

LONG = " ".join(f"word{i % 977}" for i in range(40_000))
PROSE = "The quick brown fox jumps over the lazy dog while seven bright stars shine above a quiet northern river bank at night "
TEXTS = [None, "", " ", "\n\n", "one", "one", "one two three four", LONG, LONG, "a" * 5000, "x y " * 3000, PROSE * 3, PROSE * 3, "ümläut straße 漢字 😀   end", "tab\tand\r\nlines\n\nmore  blanks ", "<|endoftext|> in text"]


def odd_documents(spark):
    """Nulls in every column, repeats, empty and long texts, and further columns named like the operators' own."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None, "mine", 1.5, b"x") for i, t in enumerate(TEXTS)]
    rows += [rows[6], rows[6], (None, None, None, None, None, None, None, None), (None, PROSE, "en", "s", 1, "k", 2.0, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, set_key binary")


def jaccard_brute(rows, threshold=0.8, words=5):
    """(links, smallest reachable id) by position of (id, text) rows, from plain sets."""
    sets = []
    for _, text in rows:
        w = [x for x in _split(text or "")]
        sets.append(frozenset(tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))) if w else frozenset())
    n = len(rows)
    near = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-12] for i in range(n)]
    return [len(x) for x in near], reach(rows, near)


def reach(rows, near):
    """Smallest id that links connect each row with."""
    root = list(range(len(rows)))
    for i, others in enumerate(near):
        for j in others:
            a, b = find(root, i), find(root, j)
            root[max(a, b)] = min(a, b)
    best = defaultdict(list)
    for i in range(len(rows)):
        if rows[i][0] is not None:
            best[find(root, i)].append(rows[i][0])
    return [min(best[find(root, i)], default=None) for i in range(len(rows))]


def find(root, i):
    while root[i] != i:
        i = root[i]
    return i


def _split(text):
    out, word = [], ""
    for c in text:
        if c in " \t\n\v\f\r":
            if word:
                out.append(word)
            word = ""
        else:
            word += c
    return [*out, word] if word else out


def bag(rows):
    return Counter(map(tuple, rows))
