"""Listings for the tests of the paged source. A resource is name@log; what is asked for is written to the log, which all processes share."""

import os

from siltworks.sources.paged import TryLater

SIZE, PAGES = 4, 5


def asked(log):
    if not os.path.exists(log):
        return []
    with open(log) as f:
        return f.read().split("\n")[:-1]


def fetch(resource, token, filters):
    """PAGES pages of SIZE rows; resource busy is refused once a page, resource down always."""
    name, _, log = resource.partition("@")
    at = int(token or 0)
    line = f"{name}:{at}:{sorted(filters.items())}"
    refuse = name == "down" or (name == "busy" and f"refused {line}" not in asked(log))
    with open(log, "a") as f:
        f.write(f"refused {line}\n" if refuse else f"{line}\n")
    if refuse:
        raise TryLater(0.01)
    rows = [(f"{name}{i}", "even" if i % 2 == 0 else "odd", i) for i in range(at * SIZE, (at + 1) * SIZE)]
    if "kind" in filters:
        rows = [r for r in rows if r[1] == filters["kind"]]
    return rows, str(at + 1) if at + 1 < PAGES else None
