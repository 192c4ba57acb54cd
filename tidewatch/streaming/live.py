"""The live path in one streaming query: messages are decoded, scored and judged."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewatch.operators.ingest import accepted_only, decode_events
from tidewatch.operators.scoring import SequenceModel
from tidewatch.schemas import EpisodeParams
from tidewatch.streaming.episodes_stream import outcome_stream
from tidewatch.streaming.scoring_stream import score_stream


def live_outcomes(messages: DataFrame, params: EpisodeParams = EpisodeParams(), model: SequenceModel | None = None, *,
                  delay: str = "1 minute", forget_seconds: float | None = None) -> DataFrame:
    """Messages (value, seq) to episode outcomes: two keyed states after each other, windows per session and its episode.

    ``seq`` is the order of arrival, which the source gives (``topics.in_arrival_order``, ``topics.in_file_order``). The
    watermark is set once, from the capture times, and goes through the scorer: each scored sample brings an event time that is
    its own or, if it is late, the watermark, so none is dropped between the two states and the silence timers of the second
    run by the clock of the first. Undecodable messages and samples without a time are left out.
    """
    events = accepted_only(decode_events(messages))
    return outcome_stream(score_stream(events, model, forget_seconds=forget_seconds, delay=delay, clocked=True), params)
