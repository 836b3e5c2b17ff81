"""Every default the operators use, as validated frozen dataclasses.

All windows and time-outs are seconds of event time. Numbers below are fixed values of the
detection model: results depend on them, so they are stated once here and nowhere else.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

US = 1_000_000

# Decisions, weakest first.
DECISIONS = ("Ignore", "Log", "Alert", "Block", "Escalate")

# Event types by ordinal, with short and display names.
EVENT_TYPES = ("net", "log", "proc", "auth", "file", "api", "sig", "unk")
EVENT_TYPE_DISPLAY = {
    "net": "Network", "log": "System", "proc": "Process", "auth": "Auth",
    "file": "File", "api": "API", "sig": "Signal", "unk": "System",
}

# IANA protocol numbers the model names.
PROTOCOL_NAMES = {6: "TCP", 17: "UDP", 1: "ICMP", 58: "ICMPv6"}

# TCP flag bits.
FLAG_FIN, FLAG_SYN, FLAG_RST, FLAG_ACK = 0x01, 0x02, 0x04, 0x10

EMBEDDING_DIM = 64
SSM_DIM = 32


@dataclass(frozen=True)
class FlowParams:
    """When packets of one conversation count as a new flow."""

    idle_s: float = 120.0
    active_s: float = 1800.0


@dataclass(frozen=True)
class Thresholds:
    """Upper ends of the decision bands; `escalate` is a lower end."""

    ignore: float = 0.20
    log: float = 0.40
    alert: float = 0.60
    block: float = 0.85
    escalate: float = 0.95

    def validate(self) -> "Thresholds":
        steps = (self.ignore, self.log, self.alert, self.block)
        if any(not 0.0 <= s <= 1.0 for s in steps) or list(steps) != sorted(set(steps)):
            raise ValueError(f"decision thresholds must rise within [0, 1]: {steps}")
        return self


# Bands used when labelled data sets are evaluated.
EVALUATION_THRESHOLDS = Thresholds(0.05, 0.10, 0.25, 0.70, 0.90)


@dataclass(frozen=True)
class GateWeights:
    local: float = 0.35
    segment: float = 0.25
    history: float = 0.15
    drift: float = 0.10
    retrieval: float = 0.10
    rule: float = 0.05


@dataclass(frozen=True)
class FusionWeights:
    local: float = 0.35
    segment: float = 0.25
    history: float = 0.20
    drift: float = 0.10
    retrieval: float = 0.05
    rule: float = 0.05


@dataclass(frozen=True)
class GateParams:
    weights: GateWeights = GateWeights()
    threshold: float = 0.35
    skip_local: float = 0.10
    force_local: float = 0.90
    force_drift: float = 6.0
    force_history: float = 0.70


@dataclass(frozen=True)
class ReasoningParams:
    fp_suppression: float = 0.2
    high_severity: float = 0.85


@dataclass(frozen=True)
class FlushParams:
    max_events: int = 100
    max_age_s: float = 10.0
    anomaly: float = 0.70
    on_session_end: bool = True
    on_type_change: bool = True

    def validate(self) -> "FlushParams":
        if self.max_events < 1 or self.max_age_s <= 0:
            raise ValueError("flush limits must be positive")
        return self


@dataclass(frozen=True)
class RoutingParams:
    skip_threshold: float = 0.20
    skip_drift: float = 1.0
    min_segments: int = 3
    force_anomaly: float = 0.90
    mid_tick: int = 10
    mid_anomaly: float = 0.55
    mid_drift: float = 3.0
    global_tick: int = 60
    global_drift: float = 8.0
    global_history: float = 0.70
    top_tick: int = 600
    baseline_alpha: float = 0.01
    history_alpha: float = 0.05


@dataclass(frozen=True)
class SsmParams:
    """Diagonal recurrence used when no trained matrices are supplied."""

    a_log: float = -0.5
    b: float = 0.1
    delta: float = 0.5
    c: float = 1.0
    d: float = 0.0
    max_energy: float = 100.0
    clamp: float = 10.0


@dataclass(frozen=True)
class MemoryParams:
    write_gate: float = 0.50
    force_gate: float = 0.85
    drift_gate: float = 5.0
    write_on_high_drift: bool = False
    max_age_s: float = 3600.0
    recency_tau_s: float = 600.0
    w_similarity: float = 0.50
    w_score: float = 0.30
    w_recency: float = 0.20
    top_k: int = 8
    ttl_s: float = 86400.0


# Retrieval scopes as (scope, k, scope weight); global is searched wide when any
# narrower scope had a hit, which the force rule makes the usual case.
RETRIEVAL_SCOPES = (("ip", 3, 1.0), ("user", 2, 0.9), ("session", 2, 0.85), ("host", 2, 0.7))
GLOBAL_SCOPE = ("global", 1, 4, 0.5)

# Records kept per memory scope.
MEMORY_LIMITS = {
    "global": 100_000, "host": 10_000, "ip": 5_000,
    "user": 5_000, "session": 1_000, "process": 1_000,
}


@dataclass(frozen=True)
class CorrelationParams:
    repeat_n: int = 3
    repeat_window_s: float = 60.0
    dist_sources: int = 5
    dist_window_s: float = 60.0
    slow_n: int = 10
    slow_score: float = 0.30
    slow_window_s: float = 3600.0
    repeat_weight: float = 0.20
    stage_weight: float = 0.30
    dist_weight: float = 0.25
    slow_weight: float = 0.15
    escalate_above: float = 0.4
    campaign_idle_s: float = 1800.0
    campaign_max_s: float | None = None  # a session older than this ends, so that a class that never rests does not join everything
    campaign_min_score: float = 0.4
    keep_per_ip: int = 500
    keep_per_host: int = 1000
    keep_global: int = 5000


@dataclass(frozen=True)
class AttackPattern:
    name: str
    stages: tuple[str, ...]
    max_gap_s: float


# Known multi-stage attacks.
ATTACK_PATTERNS = (
    AttackPattern(
        "LateralMovement",
        ("PortScan", "BruteForce/CredentialStuffing", "LateralMovement/Persistence"),
        600.0,
    ),
    AttackPattern(
        "APT-Exfiltration",
        ("BruteForce/CredentialStuffing", "FileSystemAnomaly/Ransomware", "EncryptedC2/Exfiltration"),
        3600.0,
    ),
)


@dataclass(frozen=True)
class SuspicionParams:
    near_window_s: float = 60.0
    near_n: int = 5
    near_min: float = 0.25
    near_max: float = 0.6
    near_boost: float = 0.4
    ip_rows: int = 20
    ip_min_rows: int = 4
    ip_boost: float = 0.5


@dataclass(frozen=True)
class DecisionParams:
    """Override, hysteresis and cooldown rules applied per source."""

    allow: tuple[str, ...] = ()
    block: tuple[str, ...] = ()
    min_confidence: float = 0.1
    escalate_history: float = 0.85
    escalate_drift: float = 8.0
    repeat_n: int = 10
    repeat_window_s: float = 300.0
    hold_s: float = 10.0
    hysteresis: float = 0.05
    alert_cooldown_s: float = 5.0
    block_cooldown_s: float = 30.0
    learning: bool = False
    thresholds: Thresholds = Thresholds()


# Learning rate per baseline scope; sources at or above `freeze` do not move it.
BASELINE_ALPHA = {"global": 0.001, "ip": 0.05, "user": 0.02, "host": 0.005}


@dataclass(frozen=True)
class AdaptiveParams:
    freeze: float = 0.70
    k_alert: float = 3.0
    k_block: float = 5.0
    alert_min: float = 0.30
    alert_max: float = 0.90
    threshold_min: float = 0.10
    threshold_max: float = 0.95
    base_gate: float = 0.35
    gate_k: float = 0.5
    shift: float = 0.005


# Subscription plans as (sensors, retention days, events per month).
PLANS = {
    "free": (1, 7, 1_000_000),
    "pro": (5, 30, 10_000_000),
    "enterprise": (999, 365, 999_999_999),
}

ONLINE_WITHIN_S = 120
LARGE_TRAFFIC_BYTES = 1_000_000
RATE_LIMIT_N, RATE_LIMIT_WINDOW_S = 5, 300.0
FIRST_RULE_SID = 1_000_000


@dataclass(frozen=True)
class Profile:
    """One bundle of parameters; `scaled` stretches every window by the same factor."""

    thresholds: Thresholds = Thresholds()
    gate: GateParams = GateParams()
    fusion: FusionWeights = FusionWeights()
    reasoning: ReasoningParams = ReasoningParams()
    flush: FlushParams = FlushParams()
    routing: RoutingParams = RoutingParams()
    memory: MemoryParams = MemoryParams()
    correlation: CorrelationParams = CorrelationParams()
    suspicion: SuspicionParams = SuspicionParams()
    decision: DecisionParams = DecisionParams()
    adaptive: AdaptiveParams = AdaptiveParams()
    patterns: tuple[AttackPattern, ...] = ATTACK_PATTERNS
    slice_s: float = field(default=900.0)

    def validate(self) -> "Profile":
        self.thresholds.validate()
        self.flush.validate()
        if self.slice_s <= 0:
            raise ValueError("slice_s must be positive")
        return self


def sparse_profile() -> Profile:
    """Windows for slow synthetic data: a minute becomes a day, longer windows up to a month."""
    day = 86400.0
    base = Profile()
    return replace(
        base,
        correlation=replace(
            base.correlation, repeat_window_s=day, dist_window_s=day,
            slow_window_s=30 * day, campaign_idle_s=15 * day,
        ),
        suspicion=replace(base.suspicion, near_window_s=day),
        decision=replace(
            base.decision, repeat_window_s=5 * day, hold_s=day / 6,
            alert_cooldown_s=day / 12, block_cooldown_s=day / 2,
        ),
        memory=replace(base.memory, max_age_s=30 * day, recency_tau_s=10 * day),
        flush=replace(base.flush, max_age_s=day / 6),
        patterns=tuple(
            replace(p, max_gap_s=10 * day if p.max_gap_s <= 600 else 30 * day)
            for p in base.patterns
        ),
        slice_s=day,
    ).validate()
