"""Fixed values.  Results depend on them, so they are stated once, as they are."""

# --- fixed values: design node types, in index order -------------------------------------
NODE_TYPES = (
    "FRAME",
    "GROUP",
    "TEXT",
    "RECTANGLE",
    "ELLIPSE",
    "LINE",
    "VECTOR",
    "BOOLEAN_OPERATION",
    "INSTANCE",
)
DEFAULT_TYPE = "FRAME"

# fixed values: types that never take children when scores are decoded
LEAF_TYPES = ("RECTANGLE", "ELLIPSE", "LINE", "VECTOR")

# fixed values: HTML tag -> design node type
TAG_TYPES = {
    "a": "INSTANCE",
    "button": "INSTANCE",
    "div": "FRAME",
    "header": "FRAME",
    "footer": "FRAME",
    "nav": "FRAME",
    "section": "FRAME",
    "article": "FRAME",
    "main": "FRAME",
    "aside": "FRAME",
    "p": "TEXT",
    "h1": "TEXT",
    "h2": "TEXT",
    "h3": "TEXT",
    "h4": "TEXT",
    "h5": "TEXT",
    "h6": "TEXT",
    "span": "TEXT",
    "strong": "TEXT",
    "em": "TEXT",
    "img": "RECTANGLE",
    "video": "RECTANGLE",
    "canvas": "RECTANGLE",
    "ul": "FRAME",
    "ol": "FRAME",
    "li": "FRAME",
    "table": "FRAME",
    "tr": "FRAME",
    "td": "FRAME",
    "th": "FRAME",
    "form": "FRAME",
    "input": "RECTANGLE",
    "textarea": "RECTANGLE",
    "select": "RECTANGLE",
}

# --- fixed values: tags that are not drawn -----------------------------------------------
SKIP_TAGS = ("html", "head", "body", "script", "style", "meta", "link")
SKIP_TAGS_RENDERED = SKIP_TAGS + ("noscript",)
TEXT_LIMIT = 100  # code points of direct text in a serialised node
MIN_PAGE_CHARS = 200

# --- fixed values: patterns that node names are read with
NAME_TAG = r"^<(\w+)"
NAME_ATTRIBUTE = r"""=["']([^"']+)["']"""  # behind the attribute's name
NAME_FIRST_WORD = r"(\S+)"

# --- fixed values: patterns of colours in CSS values and in inline styles
CSS_RGB = r"rgba?\(([^)]+)\)"
INLINE_HEX = r"(?:background(?:-color)?|color)\s*:\s*(#[0-9a-fA-F]{3,6})"
INLINE_RGB = r"(?:background(?:-color)?|color)\s*:\s*rgb\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\)"

# --- fixed values: viewport, square target space and patch grid --------------------------
VIEWPORT_WIDTH = 1280
VIEWPORT_HEIGHT = 800
TARGET_SIZE = 224
PATCH_SIZE = 16
GRID_SIZE = 14

# --- fixed values: style fields, their norms and their choices ---------------------------
STYLE_NORMS = {
    "borderRadius": 50.0,
    "borderWidth": 10.0,
    "opacity": 1.0,
    "fontSize": 64.0,
    "fontWeight": 900.0,
}
STYLE_COLORS = ("backgroundColor", "color", "borderColor")
STYLE_CHOICES = {
    "textAlign": ("start", "left", "center", "right", "justify", "end"),
    "display": ("block", "inline", "inline-block", "flex", "grid", "none", "table", "inline-flex"),
}

# --- fixed values: scoring ---------------------------------------------------------------
MASKED_SCORE = -1.0e4
LOSS_WEIGHTS = {
    "type": 1.0,
    "struct": 0.5,
    "align_bce": 0.3,
    "align_nce": 0.05,
    "style_reg": 0.2,
    "style_color": 0.05,
    "style_cls": 0.1,
}
OVERLAP_THRESHOLD = 0.3
MIN_CONFIDENCE = 0.3
MAX_NODES = 96
MAX_DEPTH_INDEX = 31
VISIBLE_ALPHA = 0.05
POS_WEIGHT_CAP = 20.0
NCE_TEMPERATURE = 0.1
NO_TOTAL = 1.0e9
TRAIN_RATIO = 0.85
SEED = 42
