"""Features of pairs by plain loops over a small presence set."""

from collections import defaultdict
from itertools import combinations
from math import exp, log2


def cells_of(rows):
    cells = defaultdict(set)
    for user, cell, time_bin in rows:
        cells[cell, time_bin].add(user)
    return cells


def coocs_of(rows):
    met = defaultdict(list)
    for (cell, time_bin), users in cells_of(rows).items():
        for pair in combinations(sorted(users), 2):
            met[pair].append((time_bin, cell))
    return {pair: sorted(found) for pair, found in met.items()}


def entropy(counts):
    total = sum(counts)
    return -sum(n / total * log2(n / total) for n in counts)


def travels_of(found):
    runs, count = [[found[0]]], 0
    for before, row in zip(found, found[1:]):
        if row[0] - before[0] == 1:
            runs[-1].append(row)
        else:
            runs.append([row])
    for run in runs:
        moves = sum(a[1] != b[1] for a, b in zip(run, run[1:]))
        count += len(run) > 1 and moves == len(run) - 1
    return count


def features_of(rows):
    rows = set(rows)
    cells, met = cells_of(rows), coocs_of(rows)
    contacts = defaultdict(set)
    for a, b in met:
        contacts[a].add(b)
        contacts[b].add(a)
    visits, activity = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for user, cell, _ in rows:
        visits[cell][user] += 1
        activity[user] += 1
    calm = {cell: exp(-entropy(users.values())) for cell, users in visits.items()}
    result = {}
    for pair, found in met.items():
        timed = 0.0
        for time_bin, cell in found:
            now, before, after = (cells.get((cell, time_bin + step), set()) for step in (0, -1, 1))
            if not before & set(pair):
                timed += 1 / len(now - before)
            if not after & set(pair):
                timed += 1 / len(now - after)
        places = defaultdict(int)
        for _, cell in found:
            places[cell] += 1
        a, b = pair
        result[pair] = {
            "num_coocs": len(found), "unique_coocs": len(places), "two_unique": int(len(places) > 1),
            "diversity": exp(entropy(places.values())),
            "weighted_frequency": sum(n * calm[cell] for cell, n in places.items()),
            "coocs_w": sum(1 / (len(cells[cell, t]) - 1) for t, cell in found) / len(found),
            "arr_leav": timed / len(found), "common_travels": travels_of(found),
            "mutual": len(contacts[a] & contacts[b]) / len(contacts[a] | contacts[b]),
            "specificity": len(found) / (activity[a] + activity[b]),
        }
    return result
