"""Fixed values shared by operators. They decide results, so they are stated plainly."""

# Image checks
MIN_IMAGE_SIDE = 32
MAX_IMAGE_SIDE = 10_000
STANDARD_FORMATS = ("jpg", "jpeg", "png", "webp")
STANDARD_COLOR_SPACES = ("rgb", "bgr")
VALID_IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "tiff", "webp")
NORMALIZED_EXTENSIONS = (".jpg", ".jpeg", ".png", ".bmp", ".webp")
MANAGED_IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".tiff", ".tif", ".bmp", ".webp")
MANAGED_LABEL_EXTENSIONS = (".json", ".xml", ".txt", ".csv")

# Class balance
RARE_CLASS_SHARE = 0.01
MIN_CLASS_SAMPLES = 5
IMBALANCE_WARNING = 10

# Outliers
MIN_OBJECT_AREA = 4.0
MAX_ASPECT_RATIO = 20.0
Z_THRESHOLD = 3.0

# Gate of the import profile
MAX_DUPLICATE_RATIO = 0.15
MAX_CLASS_IMBALANCE = 10.0
MIN_ONTOLOGY_COVERAGE = 0.5
MIN_IMAGES = 10
MIN_ANNOTATIONS = 10
MIN_CLASSES = 1
MIN_QUALITY_SCORE = 0.6

# Seven sub-scores of the 0..100 score card
SCORECARD_WEIGHTS = {
    "image": 0.10,
    "annotation": 0.25,
    "geometry": 0.15,
    "coverage": 0.15,
    "balance": 0.10,
    "integrity": 0.15,
    "consistency": 0.10,
}
PRODUCTION_READY_SCORE = 75.0

# Six-factor 0..1 score
MANAGED_WEIGHTS = {
    "completeness": 0.25,
    "balance": 0.15,
    "image_quality": 0.10,
    "duplicate": 0.15,
    "missing": 0.10,
    "validation": 0.25,
}
MANAGED_CHECKS = 12

# Catalog
CATALOG_WEIGHTS = {
    "quality": 0.30,
    "coverage": 0.25,
    "diversity": 0.15,
    "license": 0.15,
    "source": 0.15,
}
RECOMMENDATION_LIMIT = 20
RECOMMENDATION_MIN_SCORE = 0.3
GAP_RECOMMENDATION_LIMIT = 10
GAP_SOURCES_LIMIT = 5
MAX_PENDING_REVIEW = 100
MAX_ACTIVE_PLANS = 5
PLAN_BUDGET_LIMIT = 10_000.0
PLAN_MIN_PRIORITY = 0.4
ACTIVE_PLAN_STATES = ("draft", "active", "in_progress")
MIN_RELIABILITY = 0.1
MAX_RELIABILITY = 1.0

# Splits
TRAIN_RATIO = 0.70
VALIDATION_RATIO = 0.15
TEST_RATIO = 0.15
SPLIT_SEED = 42

# Ontology expansion
CATEGORY_DECAY = 0.90
EQUIVALENT_DECAY = 0.88
DEPTH_PENALTY = 0.95
MAX_PARENT_DEPTH = 4
SOURCE_MULTIPLIER = {
    "direct": 1.0,
    "synonym": 1.0,
    "alias": 0.92,
    "category": 0.90,
    "equivalent": 0.92,
}

# Documents
MAX_STRING_LENGTH = 5000
SEARCH_LIMIT = 10
KEYWORD_BOOST = 1.5

# Training runs
CHECKPOINTS_KEPT = 3
EARLY_STOP_PATIENCE = 10
EARLY_STOP_DELTA = 0.001
