"""Brute force that several tests share."""

from collections import Counter


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def roots(seq):
    """Smallest member of each sequence's group under links of 80 %, by brute force."""
    root = list(range(len(seq)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def similar(a, b):
        most = max(len(a), len(b))
        common = (Counter(a) & Counter(b)).total()  # so many words can stay, all others are edits
        return (most - common) * 100 <= 20 * most and edits(a, b) * 100 <= 20 * most

    for i, a in enumerate(seq):
        for j in range(i):
            if find(i) != find(j) and (a == seq[j] or similar(a, seq[j])):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(seq))]
