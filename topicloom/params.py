"""Model parameters shared by every trainer."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class TopicParams:
    """Settings of a topic model; the defaults are the reference's stream settings.

    ``vocab_capacity`` bounds the ageing dictionary (None: it keeps every term), ``rate`` is both the weight
    of a new batch and the decay per elapsed batch, ``duration`` is the length
    of one batch in the unit of the batch time.

    Ours: a shard sweeps ``sweeps_per_sync`` times between two exchanges of word
    counts (by default, and in the reference, counts are exchanged after every
    sweep), and ``block_tokens`` tokens are drawn from one state of the counts (1
    is the plain sequential sampler). A document longer than ``segment_tokens`` is
    swept in segments, each with the others' counts as of the last exchange. ``sampler``
    is ``"gibbs"``, whose work per token grows with the topics, or ``"mh"``: ``mh_steps``
    Metropolis-Hastings steps per token and sweep, whose work does not.
    """

    # Defaults of the reference's option objects.
    num_topics: int = 10
    alpha: float = 1.0
    beta: float = 1.0
    rate: float = 0.2
    batch_iterations: int = 10
    iterations: int = 100
    vocab_capacity: int | None = 1_000_000
    duration: int = 60_000
    kept_samples: int = 5
    top_words: int = 20

    # Ours: randomness and shard layout.
    seed: int = 42
    tokens_per_shard: int = 200_000
    segment_tokens: int = 65_536
    block_tokens: int = 2_048
    sweeps_per_sync: int = 1
    sampler: str = "gibbs"
    mh_steps: int = 4

    def __post_init__(self) -> None:
        positive = (
            "num_topics", "batch_iterations", "iterations", "vocab_capacity", "duration",
            "kept_samples", "top_words", "tokens_per_shard",
            "segment_tokens", "block_tokens", "sweeps_per_sync", "mh_steps",
        )
        for name in positive:
            if (value := getattr(self, name)) is None and name == "vocab_capacity":
                continue
            if value < 1:
                raise ValueError(f"{name} must be at least 1, got {value}")
        if self.alpha < 0 or self.beta < 0:
            raise ValueError("alpha and beta must not be negative")
        if self.sampler not in ("gibbs", "mh"):
            raise ValueError(f"sampler is 'gibbs' or 'mh', not {self.sampler!r}")
        if not 0.0 <= self.rate <= 1.0:
            raise ValueError(f"rate must lie in [0, 1], got {self.rate}")

    def reseeded(self, stream: int) -> TopicParams:
        """The same settings with the seed of an independent stream of draws; 0 keeps the seed."""
        return replace(self, seed=(self.seed + 0x9E3779B1 * stream) % 2**31)
