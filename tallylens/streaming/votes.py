"""Live consensus: votes arrive as a stream and findings freeze by the same rule as the batch operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "disc long, vote_id long, fate string, n long, legitimos long, congelada boolean"
STATE = "n long, legit long, stop boolean, voters array<long>"


def consensus_stream(votes: DataFrame, least: int = 5, percent: int = 80) -> DataFrame:
    """The fate of each vote of a stream (disc, voter, legit, ts, vote_id); a finding's voters are kept until it
    freezes, after which nothing but its counts is. Within a batch, votes are taken in order of time and id."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, legit, stop, voters = state.get if state.exists else (0, 0, False, [])
        voters, rows = set(voters), []
        for r in pd.concat(list(frames)).sort_values(["ts", "vote_id"]).itertuples():
            fate = "frozen" if stop else "duplicate" if r.voter in voters else "accepted"
            if fate == "accepted":
                n, legit = n + 1, legit + bool(r.legit)
                voters.add(r.voter)
                stop = n >= least and 100 * max(legit, n - legit) >= percent * n
            rows.append((key[0], r.vote_id, fate, n, legit, stop))
        state.update((n, legit, stop, [] if stop else sorted(int(v) for v in voters)))
        yield pd.DataFrame(rows, columns=["disc", "vote_id", "fate", "n", "legitimos", "congelada"])

    return votes.groupBy("disc").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
