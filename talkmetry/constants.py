"""Names, limits and tables that results depend on.

They are data, not logic: changing one changes the numbers a query returns.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

KEYS = ("run", "conv_index")

# --- roles -------------------------------------------------------------------
ROLES = ("tutor", "student")
DATASET_ROLE_MAP = {"Teacher": "tutor", "Student": "student"}
CHAT_ROLE_MAP = {"user": "student", "assistant": "tutor"}

# --- backend names -----------------------------------------------------------
BACKEND_SHORT = {
    "gpt-realtime": "GPT",
    "gemini-live": "Gemini",
    "personaplex": "PersonaPlex",
    "moshivis": "MoshiVis",
    "human": "Human",
}
IMAGE_CAPABLE_BACKENDS = ("moshivis", "gpt-realtime", "gemini-live")

# --- transcript metrics (milliseconds) ---------------------------------------
BACKCHANNEL_MAX_MS = 1500
BACKCHANNEL_MAX_WORDS = 4
END_TOKEN = "[END]"
PROMPT_TAIL_CHARS = 800
RAW_KEEP_CHARS = 1000

# --- segmentation (milliseconds) ---------------------------------------------
SEGMENT_SILENCE_MS = 1000
ASR_SPLIT_GAP_MS = 1500
CORPUS_SPLIT_GAP_MS = 500
ALIGN_MIN_MS = 100
SILENCE_LABELS = ("", "sil", "sp", "spn")
LOW_CONFIDENCE = -2.0

# --- alignment variants ------------------------------------------------------
VARIANT_PRIORITY = ("whisper_mms", "whisper_mfa", "text_mms")

# --- turn-taking events ------------------------------------------------------


@dataclass(frozen=True)
class Thresholds:
    """Decision limits of the turn-taking events (milliseconds, probabilities)."""

    merge_gap_ms: int = 180
    max_gap_ms: int = 4000
    pause_min_ms: int = 250
    pause_max_ms: int = 4000
    guard_pre_ms: int = 300
    w_decision_ms: int = 1500
    yield_thresh: float = 0.5
    hold_thresh: float = 0.5
    p_now_shift_thresh: float = 0.5
    read_smooth_frames: int = 1
    fto_clip_ms: int = 2000

    def as_dict(self) -> dict:
        return asdict(self)


THRESHOLDS = Thresholds()
CUE_LABELS = (
    "Early-Yield",
    "Late-Yield",
    "Yield-NotCued",
    "Strong-Hold",
    "Weak-Hold",
    "Hold-Misread",
)
CELLS = (
    "appropriate_uptake",
    "missed_yield",
    "false_interruption",
    "appropriate_restraint",
)
SCOPES = ("tutor", "student", "pooled")

# --- timing distributions: inclusive support and bins (milliseconds) ----------
TIMING_SUPPORT_MS = {
    "fto_s": (-2000, 2000),
    "gap_s": (0, 2000),
    "overlap_s": (0, 2000),
    "within_pause_s": (0, 2000),
    "turn_dur_s": (0, 20000),
}
JS_BINS = 40
BOOTSTRAP_REPLICATES = 1000

# --- frames and label windows -------------------------------------------------
FRAME_LABELS = ("C", "NA", "I", "BC", "T")
EVENT_LABELS = ("I", "T", "BC", "NA")
LABEL_FRAME_MS = 40
LABEL_WINDOW_MS = 30_000
LABEL_MIN_TAIL_MS = 240
FRAME_STEP_MS = 20
PREROLL_MS = 800
CHUNK_STEP_MS = 5_000
CHUNK_CONTEXT_MS = 20_000
CHUNK_DIRECT_MAX_MS = 160_000
PLOT_MAX_POINTS = 15_000

# --- live conversations -------------------------------------------------------
MAX_DURATION_MS = 300_000
SILENCE_TIMEOUT_MS = 10_000

# --- quality scores -----------------------------------------------------------
CHANNELS = ("tutor", "student", "mixed")
AXES = ("PQ", "PC", "CE", "CU")

# --- rubrics (scores 0 to 5) ---------------------------------------------------


@dataclass(frozen=True)
class Rubric:
    """Criteria of one judge prompt, their axes, labels and what the mean leaves out."""

    name: str
    keys: tuple[str, ...]
    axes: dict[str, tuple[str, ...]]
    labels: dict[str, str]
    compare: tuple[str, ...]
    mean_excludes: tuple[str, ...] = ()
    heading: str = ""
    report_axes: dict[str, tuple[str, ...]] = field(default_factory=dict)
    report_labels: dict[str, str] = field(default_factory=dict)


NAIVE_RUBRIC = Rubric(
    name="llm_judge",
    keys=(
        "answer_correctness",
        "scaffolding_quality",
        "student_realism",
        "phrasing_naturalness",
        "overall",
    ),
    axes={
        "Naturalness": ("phrasing_naturalness", "student_realism"),
        "Effectiveness": ("answer_correctness", "scaffolding_quality"),
        "Engagement": ("overall",),
    },
    labels={
        "answer_correctness": "Correctness",
        "scaffolding_quality": "Scaffolding",
        "student_realism": "Stu.realism",
        "phrasing_naturalness": "Naturalness",
        "overall": "Overall",
    },
    compare=("scaffolding_quality", "overall", "mean_component_score"),
    mean_excludes=("overall",),
    # Fixed values of the report text.
    heading="LLM JUDGE (naive)",
    report_axes={
        "Naturalness": ("phrasing_naturalness", "student_realism"),
        "Tutoring effectiveness": ("answer_correctness", "scaffolding_quality"),
        "Engagement / holistic": ("overall",),
    },
    report_labels={
        "answer_correctness": "Answer correctness",
        "scaffolding_quality": "Scaffolding quality",
        "student_realism": "Student realism",
        "phrasing_naturalness": "Phrasing naturalness",
        "overall": "Overall",
    },
)
TAXONOMY_RUBRIC = Rubric(
    name="llm_judge_bea",
    keys=(
        "confusion_identification",
        "confusion_location",
        "answer_withheld",
        "guidance_quality",
        "actionability",
        "coherence",
        "tutor_tone",
        "human_likeness",
    ),
    axes={
        "Error diagnosis": ("confusion_identification", "confusion_location"),
        "Pedagogical quality": ("answer_withheld", "guidance_quality", "actionability"),
        "Dialogue quality": ("coherence", "tutor_tone", "human_likeness"),
    },
    labels={
        "confusion_identification": "Confusion ID",
        "confusion_location": "Conf.location",
        "answer_withheld": "Ans.withheld",
        "guidance_quality": "Guidance",
        "actionability": "Actionability",
        "coherence": "Coherence",
        "tutor_tone": "Tutor tone",
        "human_likeness": "Human-like",
    },
    compare=("guidance_quality", "actionability", "mean_component_score"),
    # Fixed values of the report text.
    heading="LLM JUDGE (BEA 2025 — Maurya et al., NAACL 2025)",
    report_labels={
        "confusion_identification": "Confusion ID",
        "confusion_location": "Confusion location",
        "answer_withheld": "Answer withheld",
        "guidance_quality": "Guidance quality",
        "actionability": "Actionability",
        "coherence": "Coherence",
        "tutor_tone": "Tutor tone",
        "human_likeness": "Human-likeness",
    },
)
JUDGE_DIR_MARKER = "__judge-"

# --- manifests ------------------------------------------------------------------
OUTPUT_AFFECTING_ARGS = (
    "tutor_backend",
    "student_backend",
    "tutor_voice",
    "student_voice",
    "gpt_model",
    "tutor_gpt_voice",
    "student_gpt_voice",
    "gemini_model",
    "tutor_gemini_voice",
    "student_gemini_voice",
    "max_duration",
    "split",
    "attempts",
)

# --- 97.5 % points of Student's t for 1 to 9 degrees of freedom ------------------
T_975 = (
    12.706204736174694,
    4.302652729749462,
    3.182446305283708,
    2.7764451051977934,
    2.5705818356363146,
    2.4469118511449786,
    2.3646242515927853,
    2.306004135204168,
    2.2621571628540993,
)
Z_975 = 1.959963984540054

# Failures of a judge worth another try, by status and by parts of the error's name.
TRANSIENT_FIELDS = ("status_code", "code")
TRANSIENT_STATUS = frozenset({408, 409, 429, 500, 502, 503, 504})
TRANSIENT_NAMES = ("timeout", "connection", "servererror", "unavailable", "ratelimit", "overloaded")
