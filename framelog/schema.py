"""Schemas and constants of frame logs.

Timestamps are BIGINT nanoseconds: TimestampType holds microseconds only. Unsigned 32-bit values are BIGINT; unsigned 64-bit
offsets are DECIMAL(20,0).
"""

from __future__ import annotations

# Fixed values of the index format: flag bits, record size, layout.
DRIVER_ERROR, CORRUPT, GAP_BEFORE = 1, 2, 4
NOT_OK = DRIVER_ERROR | CORRUPT
RECORD_BYTES = 32
#: (name, first byte, bytes) of each little-endian field of a record.
RECORD_FIELDS = (("byte_offset", 0, 8), ("length", 8, 4), ("ts_ns", 12, 8), ("seq", 20, 4), ("flags", 24, 4), ("dropped_before", 28, 4))
FORMAT_VERSION = 1

INDEX = "session string, segment int, local_index long, byte_offset decimal(20,0), length long, ts_ns long, seq long, flags long, dropped_before long"

_FORMAT = "struct<pixelformat:string,width:int,height:int,fps:double>"
_CLOCKS = "struct<monotonic_ns:bigint,realtime_ns:bigint,sample_spread_ns:bigint>"
MANIFEST = (
    "format_version int, session string, written_by string, files struct<stream:string,index:string>, "
    "device struct<path:string,node_at_capture:string,driver:string,card:string,bus_info:string,"
    "usb:struct<vendor_id:string,product_id:string,vendor:string,product:string,serial:string,speed_mbps:int>>, "
    f"requested {_FORMAT}, granted {_FORMAT}, "
    "timebase struct<clock:string,source:string,comparable_with_monotonic_ns:boolean,capture_offset_ns:bigint,capture_offset_method:string>, "
    f"started {_CLOCKS}, ended {_CLOCKS}, host struct<hostname:string,kernel:string>, notes map<string,string>, "
    "segments array<struct<number:int,stream:string,index:string,frames:bigint,bytes:bigint,first_ts_mono_ns:bigint,last_ts_mono_ns:bigint>>, "
    "frames_written bigint, bytes_written bigint, counters struct<frames:bigint,driver_dropped:bigint,driver_errors:bigint,corrupt:bigint>, "
    "duration_ns bigint, effective_fps double, writer struct<queue_high_water:bigint,queue_depth:bigint,frames_flagged:bigint>"
)
