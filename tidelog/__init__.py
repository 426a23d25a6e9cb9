"""tidelog: ordered, versioned key-value analytics expressed as Spark plans.

Every change is a row of an operation log ``(key, seq, is_tombstone, value)``.
The visible state is the newest operation of each key, without deletes, in
unsigned byte order of the key.
"""
from tidelog.model import Config
from tidelog.store import Store

__all__ = ["Config", "Store"]
