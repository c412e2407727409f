"""Colinear chaining of a read's alignments and the typed breakpoints between them.

The chain is a small dynamic programme over the alignments of one read, so it runs per read in grouped Arrow batches;
reads are many and small, and Spark spreads them by read_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

CHAINS = "read_id string, chrom string, pos long, other_chrom string, other_pos long, type int"


def chain_breakpoints(df: DataFrame, distance: int) -> DataFrame:
    """Breakpoints between neighbours of each read's longest chain.

    df: read_id, read_start, read_end (in read order), chrom, start, end, reverse. Alignments of a read are chained in
    read order where one begins no more than distance before the other ends; the chain with most aligned read bases
    wins, then the one with the fewest breakpoints. Types: 1 other contig, 2 other strand, 3 order or distance on the
    contig, 4 an end of the chain (other_chrom null, other_pos -1).
    """

    def chains(key, pdf):
        import pandas as pd

        rows = pdf.sort_values(["read_start", "read_end", "chrom", "start"]).reset_index(drop=True)
        # alignments inside another one (in read coordinates) add nothing
        keep, reach = [], -1
        for i, r in rows.iterrows():
            if r.read_end > reach:
                keep.append(i)
                reach = r.read_end
        rows = rows.loc[keep].reset_index(drop=True)

        def kind(a, b) -> int:
            if a.chrom != b.chrom:
                return 1
            if a.reverse != b.reverse:
                return 2
            gap = (a.start - b.end) if a.reverse else (b.start - a.end)
            return 3 if abs(gap - (b.read_start - a.read_end)) > distance else 0

        n = len(rows)
        items = [rows.iloc[i] for i in range(n)]
        best, before = [None] * n, [-1] * n
        for j in range(n):
            best[j] = (int(items[j].read_end - items[j].read_start), 0)
            for i in range(j):
                if items[j].read_start >= items[i].read_end - distance:
                    size = best[i][0] + int(items[j].read_end - max(items[j].read_start, items[i].read_end))
                    score = (size, best[i][1] - (kind(items[i], items[j]) > 0))
                    if score > best[j]:
                        best[j], before[j] = score, i
        at = max(range(n), key=lambda i: (best[i], -i))
        path = []
        while at >= 0:
            path.append(items[at])
            at = before[at]
        path.reverse()
        out = []

        def left(a):
            return int(a.end if a.reverse else a.start)

        def right(a):
            return int(a.start if a.reverse else a.end)

        out.append((key[0], path[0].chrom, left(path[0]), None, -1, 4))
        for a, b in zip(path, path[1:]):
            t = kind(a, b)
            if t:
                out.append((key[0], a.chrom, right(a), b.chrom, left(b), t))
        out.append((key[0], path[-1].chrom, right(path[-1]), None, -1, 4))
        return pd.DataFrame(out, columns=["read_id", "chrom", "pos", "other_chrom", "other_pos", "type"])

    return df.groupBy("read_id").applyInPandas(chains, CHAINS)
