"""Every tunable number, passed explicitly to the operators that use it."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed value: the claim marker of a story whose upload is under way.
PENDING = "__pending__"


@dataclass(frozen=True)
class Config:
    # tracker, seconds
    live_min: int = 1800
    live_max: int = 604_800
    soft: int = 3600
    error_base: int = 600
    error_max: int = 86_400
    check_batch: int = 15
    collapse_ratio: float = 0.35
    collapse_min_length: int = 800
    # threshold
    default_threshold: int = 3
    dynamic: bool = True
    min_threshold: int = 3
    max_threshold: int = 12
    voters_per_vote: int = 30
    active_days: int = 7
    # archive
    pending_timeout: int = 600
    retry_base: int = 300
    retry_max: int = 21_600
    max_attempts: int = 10
    sweep_candidates: int = 60
    sweep_retries: int = 5
    # collector
    capture_budget: int = 20
    items_per_feed: int = 30
    # promoter
    promote_batch: int = 3
    auto_critique: bool = False
    min_volatility: int = 0
    llm_attempts: int = 5
    relevance_attempts: int = 2
    body_chars: int = 2500
    min_source: int = 80
    gate: bool = True
    gate_score: int = 7
    # snapshot queue
    wayback_enabled: bool = True
    submit_budget: int = 4
    poll_budget: int = 10
    submit_attempts: int = 3
    poll_backoff: int = 120
    # cleanup
    orphan_days: int = 14
    orphan_votes: int = 0
    # rate limits
    rate_window: int = 600
    per_ip: int = 5
    overall: int = 20
    recheck_per_ip: int = 20
    # listings
    list_max: int = 200
    feed_size: int = 50
    series_max_days: int = 90
