"""Decoded packets -> traffic records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# TCP flag letter of each count.
FLAG_LETTERS = {"syn_count": "S", "ack_count": "A", "fin_count": "F", "rst_count": "R", "psh_count": "P",
                "urg_count": "U"}


def packets_to_events(packets: DataFrame) -> DataFrame:
    """One traffic record per IP packet.

    Expects time, length, ip_src, ip_dst, ttl, ip_flags, ip_frag, payload_length, and for TCP/UDP
    sport, dport, window, flags. Packets without an IP header (ip_src NULL) are dropped.
    """
    transport = F.col("sport").isNotNull() | F.col("dport").isNotNull()
    fragment = (F.coalesce(F.col("ip_flags"), F.lit(0)) != 0) & (F.coalesce(F.col("ip_frag"), F.lit(0)) != 0)
    flags = {name: F.when(transport, (F.instr(F.coalesce(F.col("flags"), F.lit("")), letter) > 0).cast("int"))
             for name, letter in FLAG_LETTERS.items()}
    return packets.where(F.col("ip_src").isNotNull()).select(
        F.col("time").alias("timestamp"), F.col("length").alias("bytes"), F.lit(1).alias("packets"),
        F.col("ttl"), fragment.cast("int").alias("fragment_count"), F.col("payload_length").alias("payload_size"),
        F.col("ip_src").alias("src_ip"), F.col("ip_dst").alias("dst_ip"),
        F.when(transport, F.coalesce(F.col("sport"), F.lit(0))).alias("src_port"),
        F.when(transport, F.coalesce(F.col("dport"), F.lit(0))).alias("dst_port"),
        F.when(transport, F.coalesce(F.col("window"), F.lit(0))).alias("tcp_window"),
        *[value.alias(name) for name, value in flags.items()],
    )
