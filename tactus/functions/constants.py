"""Fixed values shared by the operators.

Everything in this file has to equal the published chart formats and rating scales for results to be
right, so the values are stated plainly and in natural order.
"""

from __future__ import annotations

# Note characters and their integer codes. Any other character is an empty panel.
CODE_BY_CHAR = {"1": 1, "2": 2, "3": 3, "4": 4, "M": 5, "L": 6}
CHAR_BY_CODE = ("0", "1", "2", "3", "4", "M", "L")
TAP, HOLD, TAIL, ROLL, MINE, LIFT = 1, 2, 3, 4, 5, 6
STEP_CODES = (TAP, HOLD, ROLL, LIFT)
HOLD_CODES = (HOLD, ROLL)
PANELS = 4
LEFT_PANEL, RIGHT_PANEL = 0, 3

# The musical grid.
BEATS_PER_MEASURE = 4
SLOTS_PER_BEAT = 12
FINE_SLOTS_PER_BEAT = 24
SLOTS_PER_MEASURE = 48
MEASURE_LINES = (4, 8, 12, 16, 24, 48)
HOLD_SLOTS = 12
MAX_DELTA = 96

# Difficulty and style names, in index order.
DIFFICULTIES = ("Beginner", "Easy", "Medium", "Hard", "Challenge", "Edit")
STYLES = ("feet", "hands", "keyboard")
DWI_DIFFICULTY = {
    "ANOTHER": "Medium",
    "BASIC": "Easy",
    "BEGINNER": "Beginner",
    "MANIAC": "Hard",
    "SMANIAC": "Challenge",
}
DWI_NAME = {
    "Beginner": "BEGINNER",
    "Easy": "BASIC",
    "Medium": "ANOTHER",
    "Hard": "MANIAC",
    "Challenge": "SMANIAC",
    "Edit": "EDIT",
}

# Which panels (left, down, up, right) a DWI character steps on.
DWI_PANELS = {
    "0": (),
    "1": (0, 1),
    "2": (1,),
    "3": (1, 3),
    "4": (0,),
    "6": (3,),
    "7": (0, 2),
    "8": (2,),
    "9": (2, 3),
    "A": (1, 2),
    "B": (0, 3),
}
# Beats one DWI character lasts inside each bracket.
DWI_STEP = {"(": 1 / 4, "[": 1 / 6, "{": 1 / 16, "`": 1 / 48}

# The four pad symmetries, as source panel per target panel.
MIRRORS = ((0, 1, 2, 3), (3, 1, 2, 0), (0, 2, 1, 3), (3, 2, 1, 0))

# File suffixes in descending preference.
SIMFILE_SUFFIXES = ("ssc", "sm", "dwi")
AUDIO_SUFFIXES = ("ogg", "mp3", "wav")

# Limits of a dance pad.
BURST_SECONDS = 1.0
SUSTAINED_SECONDS = 10.0
MAX_BURST = 20.0
MAX_SUSTAINED = 12.0
FAST_JACK = 0.09
STREAM_GAP = 0.16
MIN_JACK = 0.15
MIN_JUMP_ROOM = 0.13

# Notes per second by rating, one table per rating scale, rating 0 first.
NPS_10 = (0.60, 0.88, 1.07, 1.43, 1.79, 2.19, 2.57, 3.00, 3.48, 4.10, 4.96)
NPS_15 = (
    0.60, 0.66, 1.21, 1.50, 1.87, 2.25, 2.64, 3.04, 3.63, 4.33, 5.18, 5.92, 6.67, 7.57, 8.47, 9.37,
)
NPS_20 = (
    0.60, 0.70, 0.93, 1.19, 1.45, 1.82, 2.17, 2.49, 2.75, 3.12, 3.34, 3.61, 3.94, 4.35, 4.83, 5.30,
    5.88, 6.23, 6.85, 8.07, 9.07,
)
NPS_KEYBOARD = (
    0.60, 0.90, 1.40, 2.01, 2.28, 2.56, 2.92, 3.21, 3.64, 4.65, 5.73, 6.40, 6.92, 7.63, 7.70, 7.89,
    8.03, 8.16, 8.30, 8.43, 8.57,
)
NPS_BY_SCALE = {10: NPS_10, 15: NPS_15, 20: NPS_20}

# Percent of notes on quarters, eighths and sixteenths by whole notes per second.
RHYTHM_MIX = (
    (100.0, 0.0, 0.0),
    (100.0, 0.0, 0.0),
    (79.0, 19.5, 0.0),
    (59.1, 34.0, 3.1),
    (50.0, 35.6, 9.3),
    (43.6, 33.8, 18.8),
    (38.0, 31.0, 23.1),
    (34.8, 31.2, 24.7),
    (32.8, 30.8, 31.8),
    (30.7, 30.3, 38.8),
)

# Packs and song directories written for the keyboard.
KEYBOARD_PACKS = (
    "BMR Originals-Exclusive",
    "BeMaNiRuler Originals",
    "Community Keyboard Megapack - Volume 1",
    "Community Keyboard Megapack - Volume 2",
    "DragonForce",
    "DragonForce - Ultra Beatdown",
)
KEYBOARD_SONGS = (
    "(Reach) Air",
    "BRING THE PAIN",
    "Crimson King",
    "NUMBER ONE",
    "RAMP! (the logical song)",
    "Salieri Strikes Back",
    "Strangeprogam",
    "Stratofortress",
    "Stuntin-Like-My-Daddy",
)
# Packs left out of a scan unless the caller says otherwise.
EXCLUDED_PACKS = ("MetzgerSM's S.E.X. Guitar Pack", "Vertex Minipack")

# Periodicity estimators.
PHASE_BINS = 96
FOLD_BINS = 64
PRIOR_CENTRE_BPM = 140.0
PRIOR_WIDTH_OCTAVES = 0.8
ONSET_LATENCY = 0.0046
KICK_LAG = 0.0259
KICK_CLARITY = 10.0
NO_KICK_CLARITY = 2.0
EXCERPT_SECONDS = 25.0
FRAME_RATE = 22050 / 128

# Constraint budgets.
USAGE_DECAY = 0.957
SAME_ARROW_LIMIT = 6
FAST_CROSSOVER_FRACTION = 1.0 / 6.0
SPARSE_FRACTION = 0.34
MAX_EMPTY_SHARE = 0.10
SILENCE_DROP = 6.0
SILENT_DECIBELS = -70.0
