"""Functions of columns: what the operators compute row by row or group by group."""

from ..operators.accept import night_hours, sidereal, signed_chi2
from ..operators.averages import bin_of, chi2_survival, log_edges
from ..operators.fields import beam_transfer, comoving, rotate_to_field, sky_pixel
from ..operators.maps import pixel_index
from ..operators.masking import finite, marked
from ..operators.scans import decode_feature, saddlebag, scan_type, sidelobe_score
from ..operators.series import circular_mean
from ..operators.splits import sidereal_unwrapped, winter_distance

__all__ = [
    "beam_transfer", "bin_of", "chi2_survival", "circular_mean", "comoving", "decode_feature", "finite", "log_edges", "marked", "night_hours", "pixel_index", "rotate_to_field",
    "saddlebag", "scan_type", "sidelobe_score", "sidereal", "sidereal_unwrapped", "signed_chi2", "sky_pixel", "winter_distance",
]
