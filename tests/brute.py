"""Plain definitions that the engine is held against."""


def simple_paths(edges, s, t, k):
    """(sign, length) of every simple path from s to t with at most k edges."""

    def walk(v, par, path):
        if v == t:
            yield par, len(path) - 1
            return
        if len(path) - 1 == k:
            return
        for a, b, g in edges:
            if a == v and b not in path:
                yield from walk(b, int(par == g), [*path, b])

    yield from walk(s, 1, [s])


def answer(edges, s, t, sigma, k, n):
    if not (0 <= s < n and 0 <= t < n):
        return 0
    return int(any(par == (1 if sigma == 1 else 0) for par, _ in simple_paths(edges, s, t, max(k, 0))))
