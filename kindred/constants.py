"""Fixed values that decide results. They are data, stated as they are."""

# Category names, position = class id.
CLASS_NAMES = ["bag", "sunglass", "food", "shoes", "clothes"]

# Korean folder name to category name, replaced in this order.
KOREAN_TO_ENGLISH = {
    "가방": "bag",
    "선글라스": "sunglass",
    "식음료": "food",
    "신발": "shoes",
    "의류": "clothes",
}

UNKNOWN_CLASS = "unknown"

# Embedding width, signature stages and their weights.
EMBEDDING_DIM = 1280
STAGE_SIZES = [80, 112, 192, 320]
STAGE_WEIGHTS = [0.15, 0.15, 0.15, 1.0]

# Length of the top-channel list by model.
TOP_CHANNELS = {"vgg16": 25, "efficientnet": 40}

# Pixel standardisation (RGB order) and mean subtraction (BGR order).
RGB_MEAN = [0.485, 0.456, 0.406]
RGB_STD = [0.229, 0.224, 0.225]
BGR_MEAN = [103.939, 116.779, 123.68]

# Norm floor of the search, norm addend of the signature.
NORM_FLOOR = 1e-12
NORM_ADDEND = 1e-8

# Defaults of the operators.
CONFIDENCE_THRESHOLD = 0.5
QUERIES_PER_CATEGORY = 20
CANDIDATES_PER_QUERY = 20
DIVERSITY_THRESHOLD = 0.95
MIN_SELECTED = 1
MAX_SELECTED = 20
TEST_QUERIES_PER_CATEGORY = 10
EXPORTED_SELECTIONS_PER_QUERY = 10
ROWS_PER_FILE = 500
VALIDATION_RATIO = 0.2
SPLIT_SEED = 42
