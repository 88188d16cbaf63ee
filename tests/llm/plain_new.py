"""Plain versions of conversation repair, packing checks and the Merkle manifest, for small inputs."""

import hashlib
import heapq
import re
import zlib

BLANK = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def damaged(rows):
    """{conv: [(turn, role, text)]} from (conv, turn, role, text) rows, every conversation included."""
    out = {}
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        mine = out.setdefault(conv, [])
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        mine.extend([(turn, role, text)] * (2 if kind == 3 else 1))
    for mine in out.values():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        said = text.strip(BLANK)
        out.append("b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


GOOD = re.compile(r"(s?(ua)+)?")
#: Starts of what GOOD accepts.
STARTS = re.compile(r"(s?(ua)*u?)?")


def cheapest(rows):
    """(cost, audit, repaired rows): all edit sequences in order of cost, then audit."""
    fault = faults(rows)
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, initials, kept = heapq.heappop(heap)
        if at == len(rows) and GOOD.fullmatch(initials):
            return cost, audit, list(kept)
        if (audit, at, initials) in done:
            continue
        done.add((audit, at, initials))
        moves = []
        if audit[-3:] != "III":
            moves += [(2, "I", at, who, "") for who in ("user", "assistant")]
        if at < len(rows):
            _, role, text = rows[at]
            moves.append((3, "D", at + 1, None, None))
            if fault[at] not in ("b", "d"):
                more = fault[at] == "t"
                moves.append((more, "K", at + 1, role, text))
                moves += [(2 + more, "R", at + 1, who, text) for who in ("user", "assistant")]
        for price, edit, to, role, text in moves:
            now = initials if role is None else initials + role[:1]
            if role is None or (role and STARTS.fullmatch(now)):
                heapq.heappush(heap, (cost + price, audit + edit, to, now, kept if role is None else (*kept, f"{role}:{text}")))


def repaired(rows):
    """The whole expected result by conversation."""
    out = {}
    for conv, mine in damaged(rows).items():
        turns = {t for t, _, _ in mine if t is not None}
        kinds = faults(mine)
        cost, audit, kept = cheapest(mine)
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, kinds.count("b"), kinds.count("d"), kinds.count("t"),
                     sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:])), cost, audit, sha("\n".join(kept)))
    return out


def manifest(rows):
    """[(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)] from (doc_id, source, lang, n_chars, text) rows."""
    def leaf(*values):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def up(level):
        return [sha("".join(level[i:i + 2])) for i in range(0, len(level), 2)]

    def proof(leaves, at):
        out = []
        while len(leaves) > 1:
            out += [leaves[at ^ 1]] if (at ^ 1) < len(leaves) else []
            leaves, at = up(leaves), at >> 1
        return out

    def root(leaves):
        while len(leaves) > 1:
            leaves = up(leaves)
        return leaves[0]

    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0], leaf(*r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for mine in groups.values():
        mine.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    subroots = [root([x[1] for x in groups[g]]) for g in order]
    top, out = root(subroots) if subroots else None, []
    for j, g in enumerate(order):
        leaves = [x[1] for x in groups[g]]
        for k, (i, own, r) in enumerate(groups[g]):
            path = proof(leaves, k) + proof(subroots, j)
            folded = top
            if i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and r[3] is not None:
                new = root(leaves[:k] + [leaf(r[0], r[1], r[2], r[3] + 1, r[4])] + leaves[k + 1:])
                folded = root(subroots[:j] + [new] + subroots[j + 1:])
            out.append((i, own, subroots[j], top, sha("".join(path)), folded, folded == top))
    return out
