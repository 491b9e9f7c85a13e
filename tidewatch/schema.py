"""Fixed vocabularies and option records shared by every operator."""

from __future__ import annotations

from dataclasses import dataclass

# The window features, in the order every array column uses.
FEATURES = (
    "flow_bytes",
    "flow_packets",
    "flow_duration",
    "iat_mean",
    "iat_variance",
    "iat_max",
    "bidirectional_byte_ratio",
    "bidirectional_packet_ratio",
    "syn_count",
    "ack_count",
    "fin_count",
    "rst_count",
    "psh_count",
    "urg_count",
    "ttl_mean",
    "ttl_variance",
    "tcp_window_mean",
    "tcp_window_variance",
    "fragment_count",
    "payload_mean",
    "payload_variance",
    "port_diversity",
    "sequential_port_score",
    "retransmission_count",
)

FEATURE_NOTES = {
    "flow_bytes": "bytes carried by all records of the window",
    "flow_packets": "packets carried by all records of the window",
    "flow_duration": "longest record duration seen in the window",
    "iat_mean": "average time between packets",
    "iat_variance": "population variance of the time between packets",
    "iat_max": "longest time between packets",
    "bidirectional_byte_ratio": "bytes sent by the source over bytes sent back (0 when nothing came back)",
    "bidirectional_packet_ratio": "packets sent by the source over packets sent back (0 when nothing came back)",
    "syn_count": "connection requests (SYN flags)",
    "ack_count": "acknowledgements (ACK flags)",
    "fin_count": "orderly closes (FIN flags)",
    "rst_count": "aborted connections (RST flags)",
    "psh_count": "push requests (PSH flags)",
    "urg_count": "urgent markers (URG flags)",
    "ttl_mean": "average IP time to live",
    "ttl_variance": "population variance of the IP time to live",
    "tcp_window_mean": "average advertised receive window",
    "tcp_window_variance": "population variance of the advertised receive window",
    "fragment_count": "fragmented IP packets",
    "payload_mean": "average payload size",
    "payload_variance": "population variance of the payload size",
    "port_diversity": "number of different ports touched",
    "sequential_port_score": "share of neighbouring ports that follow each other without a gap",
    "retransmission_count": "retransmitted packets",
}

# Attack stages by id.
STAGES = {
    0: "Benign",
    1: "Reconnaissance",
    2: "Initial Access",
    3: "Lateral Movement",
    4: "Command and Control",
    5: "Exfiltration",
}

# Dataset category -> stage id.
CATEGORY_STAGE = {
    "normal": 0,
    "benign": 0,
    "background": 0,
    "reconnaissance": 1,
    "analysis": 2,
    "exploits": 2,
    "fuzzers": 2,
    "shellcode": 2,
    "backdoor": 2,
    "dos": 2,
    "worms": 3,
    "generic": 4,
    "botnet": 4,
}

# Label texts that mean "no attack".
BENIGN_LABELS = ("0", "0.0", "normal", "benign", "background")

# Column names accepted for each measure, first match wins.
VALUE_ALIASES = {
    "bytes": ("bytes", "flow_bytes", "total_bytes", "tot_bytes", "totlen_fwd_pkts", "total_length_of_fwd_packets"),
    "packets": ("packets", "flow_packets", "total_packets", "tot_pkts", "tot_fwd_pkts", "total_fwd_packets"),
    "duration": ("flow_duration", "duration", "dur", "flow_duration_us"),
    "iat": ("iat", "inter_arrival_time", "flow_iat_mean"),
    "ttl": ("ttl", "ip_ttl", "ttl_mean"),
    "tcp_window": ("tcp_window", "window_size", "tcp_window_size"),
    "payload": ("payload_size", "payload_bytes", "avg_packet_size"),
    "src_bytes": ("src_bytes", "forward_bytes", "sbytes", "totlen_fwd_pkts"),
    "dst_bytes": ("dst_bytes", "backward_bytes", "dbytes", "totlen_bwd_pkts"),
    "src_packets": ("src_packets", "forward_packets", "spkts", "tot_fwd_pkts"),
    "dst_packets": ("dst_packets", "backward_packets", "dpkts", "tot_bwd_pkts"),
    "syn": ("syn_count", "tcp_syn_count", "syn_flag_count"),
    "ack": ("ack_count", "tcp_ack_count", "ack_flag_count"),
    "fin": ("fin_count", "tcp_fin_count", "fin_flag_count"),
    "rst": ("rst_count", "tcp_rst_count", "rst_flag_count"),
    "psh": ("psh_count", "tcp_psh_count", "fwd_psh_flags"),
    "urg": ("urg_count", "tcp_urg_count", "urg_flag_count"),
    "fragments": ("fragment_count", "ip_fragments"),
    "retransmissions": ("retransmissions", "retransmission_count"),
}

# Where the column-first resolution accepts other names.
COLUMN_ALIASES = VALUE_ALIASES | {
    "bytes": ("bytes", "flow_bytes", "total_bytes", "tot_bytes", "totlen_fwd_pkts", "fwd_packets_length_total"),
    "packets": ("packets", "flow_packets", "total_packets", "tot_pkts", "total_fwd_packets"),
    "duration": ("flow_duration", "duration", "dur"),
    "tcp_window": ("tcp_window", "window_size", "tcp_window_size", "init_fwd_win_bytes"),
    "payload": ("payload_size", "payload_bytes", "avg_packet_size", "packet_length_mean"),
    "src_bytes": ("src_bytes", "forward_bytes", "sbytes", "totlen_fwd_pkts", "fwd_packets_length_total"),
    "dst_bytes": ("dst_bytes", "backward_bytes", "dbytes", "totlen_bwd_pkts", "bwd_packets_length_total"),
    "src_packets": ("src_packets", "forward_packets", "spkts", "total_fwd_packets"),
    "dst_packets": ("dst_packets", "backward_packets", "dpkts", "total_backward_packets"),
    "fragments": (),
    "retransmissions": (),
}

# Port, time and label column names.
PORT_COLUMNS = ("dst_port", "destination_port", "dst_port_number", "src_port", "source_port")
TIME_COLUMNS = ("timestamp", "ts", "time")
LABEL_COLUMNS = ("label", "classlabel")
CATEGORY_COLUMNS = ("attack_cat", "family")
STAGE_COLUMNS = ("stage", "mitre_stage")
RISK_COLUMNS = ("risk", "infiltration_risk")

MOMENTS = ("iat", "ttl", "tcp_window", "payload")

ROWS_PER_GROUP = 8_192
WINDOW_SECONDS = 5.0
SEQUENCE_LENGTH = 12
HORIZON = 5
SUPERVISION_MARK = "horizon_aligned_rollout_prefixes_v1"


def _one_of(name: str, value: str, allowed: tuple[str, ...]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}; got {value!r}")


@dataclass(frozen=True)
class FeatureOptions:
    """How raw cells become numbers and how windows summarise them.

    resolve      "value": per row, the first alias holding a finite number;
                 "column": the first alias that exists as a column.
    missing      "zero": missing iat/ttl/tcp_window count as 0; "skip": only values > 0 count.
    cells        "first": a list cell gives its first number; "all": every number counts.
    ratio_guard  "zero": ratio is 0 without a denominator; "floor1": denominator is at least 1.
    """

    resolve: str = "value"
    missing: str = "zero"
    cells: str = "first"
    ratio_guard: str = "zero"

    def __post_init__(self) -> None:
        _one_of("resolve", self.resolve, ("value", "column"))
        _one_of("missing", self.missing, ("zero", "skip"))
        _one_of("cells", self.cells, ("first", "all"))
        _one_of("ratio_guard", self.ratio_guard, ("zero", "floor1"))


ONLINE = FeatureOptions()
BATCH = FeatureOptions(missing="skip", cells="all")
COLUMNAR = FeatureOptions(resolve="column", ratio_guard="floor1")


@dataclass(frozen=True)
class ForecastOptions:
    """History length, horizon and reporting settings of a forecast."""

    sequence_length: int = SEQUENCE_LENGTH
    horizon: int = HORIZON
    threshold: float = 0.5
    step_seconds: float = WINDOW_SECONDS
    max_origins: int | None = None
    trend_tolerance: float = 1e-6

    def __post_init__(self) -> None:
        if self.sequence_length < 1:
            raise ValueError("sequence_length must be at least 1")
        if self.horizon < 1:
            raise ValueError("horizon must be at least 1")
        if not 0 <= self.threshold <= 1:
            raise ValueError("threshold must be in [0, 1]")
        if not 0 < self.step_seconds < float("inf"):
            raise ValueError("step_seconds must be finite and positive")
        if self.max_origins is not None and self.max_origins < 1:
            raise ValueError("max_origins must be positive or None")
        if not 0 <= self.trend_tolerance < float("inf"):
            raise ValueError("trend_tolerance must be finite and non-negative")
