from .normalize import normalize, is_blank, prefix_lengths, split_head
from .scoring import blended_score, epoch_millis
from .hashing import hash60, unit_draw, ttl_with_jitter, storage_key
