"""Definitions in plain Python that the operators are held against."""


def mems(ref: str, query: str, least: int) -> set[tuple[int, int, int]]:
    """(ref_pos, query_pos, len), 1-based, straight from the definition."""
    out = set()
    for r in range(len(ref)):
        for q in range(len(query)):
            if r and q and ref[r - 1] == query[q - 1]:
                continue
            n = 0
            while r + n < len(ref) and q + n < len(query) and ref[r + n] == query[q + n]:
                n += 1
            if n >= least:
                out.add((r + 1, q + 1, n))
    return out


def occurrences(text: str, part: str) -> int:
    return sum(text.startswith(part, i) for i in range(len(text)))
