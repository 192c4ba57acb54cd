"""The episode rules as a table that is walked sample by sample, to check the closed form against."""

from __future__ import annotations

NORMAL, SUSPECT, BAD, RECOVERING = "normal", "suspect", "bad", "recovering"
START, END, AGAIN = "EVENT_STARTED", "EVENT_ENDED", "RE_ALERT"

# Fixed values: (state, label is bad, threshold met) -> (next state, candidate since, recovery since, outcome).
# "now" sets a time to the sample's, "-" leaves it, None clears it; AGAIN counts only once its interval has passed.
TABLE = {
    (NORMAL, True, False): (SUSPECT, "now", None, None),
    (NORMAL, False, False): (NORMAL, None, None, None),
    (SUSPECT, True, False): (SUSPECT, "-", None, None),
    (SUSPECT, True, True): (BAD, "-", None, START),
    (SUSPECT, False, False): (NORMAL, None, None, None),
    (BAD, True, False): (BAD, "-", None, AGAIN),
    (BAD, False, False): (RECOVERING, None, "now", None),
    (RECOVERING, False, False): (RECOVERING, None, "-", None),
    (RECOVERING, False, True): (NORMAL, None, None, END),
    (RECOVERING, True, False): (BAD, None, None, AGAIN),
}


def fold_session(samples, params, as_of_ms):
    """samples: [(ms, bad, user)] in order. Returns (outcomes, episodes, states after each sample)."""
    outcomes, episodes, states = [], [], []
    state, since, episode, seen = NORMAL, {"candidate": None, "recovery": None}, None, None
    # The time that a state's threshold is measured from, for the label that keeps the state.
    clock = {(SUSPECT, True): ("candidate", params.persist_ms), (RECOVERING, False): ("recovery", params.recovery_ms)}

    def finish(at, recovered):
        episode.update(end=at, recovered=recovered)
        outcomes.append((END, episode["start"], at, episode["alerts"], recovered))
        episodes.append(dict(episode))

    for ms, bad, user in samples:
        if seen is not None and ms - seen >= params.timeout_ms:
            if episode:
                finish(seen, False)
            state, since, episode = NORMAL, {"candidate": None, "recovery": None}, None
        seen = ms
        name, threshold = clock.get((state, bad), (None, 0))
        met = name is not None and ms - since[name] >= threshold
        state, *marks, outcome = TABLE[state, bad, met]
        since = {k: {"now": ms, "-": since[k]}.get(mark) for k, mark in zip(since, marks, strict=True)}
        if outcome == START:
            episode = dict(start=since["candidate"], confirm=ms, last_alert=ms, alerts=1, user=user, end=None, recovered=False)
            outcomes.append((START, episode["start"], ms, 1, False))
        elif outcome == AGAIN and ms - episode["last_alert"] >= params.realert_ms:
            episode.update(alerts=episode["alerts"] + 1, last_alert=ms)
            outcomes.append((AGAIN, episode["start"], ms, episode["alerts"], False))
        elif outcome == END:
            finish(ms, True)
            episode = None
        states.append((since["candidate"], since["recovery"], *((episode[k] for k in ("start", "last_alert", "alerts")) if episode else (None, None, 0))))
    if episode:
        if as_of_ms - seen >= params.timeout_ms:
            finish(seen, False)
        else:
            episodes.append(dict(episode))
    return outcomes, episodes, states
