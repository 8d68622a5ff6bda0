"""Values that must stay as they are for results to agree: names, constants, word lists.

Nothing here is logic.  Each block says what the values are for.
"""

# The shipped operating point and the loudness of the edit branch.
OPERATING_POINT = 0.8092
TAMPERED_SCALE = 1.25
VERDICT_CUT = 0.5
AI_CUT = 0.60
REAL_CUT = 0.40
NEUTRAL_FILL = 0.5

# The degradation grid as (kind, parameter as written).
GRID = [
    ("jpeg", "90"), ("jpeg", "70"), ("jpeg", "50"), ("jpeg", "30"),
    ("blur", "0.5"), ("blur", "1.0"), ("blur", "2.0"),
    ("resize", "0.5"), ("resize", "0.25"),
    ("noise", "0.02"), ("noise", "0.05"), ("noise", "0.1"),
    ("jitter", "0.2"),
    ("crop", "0.8"),
]

# The settings whose density matches a sampled training source.
KEPT_VARIANTS = ["clean", "jpeg50", "blur10", "noise005"]

# Split priority, strongest claim first.
SPLIT_PRIORITY = ["test_organizer", "test_ood", "test_wild", "calib_ood", "calib", "train"]

# Content classes in index order.
CONTENT_CLASSES = ["face", "animal", "object", "scene", "text"]

# Class codes.
SUBCLASS_BY_CODE = {0: "real", 1: "full_synthetic", 2: "tampered"}

# Order of the combiner's input columns.
FUSION_COLUMNS = [
    "cal_general", "cal_tampered", "cal_face", "face_present", "cal_spectral",
    "cal_text", "text_present", "content_face", "content_animal", "content_object",
    "content_scene", "content_text", "degradation_estimate", "provenance_prior",
]

# Order of the text features.
TEXT_FEATURES = [
    "conf_mean", "conf_std", "token_plausibility",
    "glyph_consistency", "frac_nonascii", "n_regions",
]

# Image file extensions.
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "webp", "bmp"]

# Path prefixes that may never feed training.
FORBIDDEN_ANYWHERE = "val2017"
FORBIDDEN_PREFIXES = ["DALLE/Advanced/DALLE3"]

# Geometry limits.
MIN_FACE_PX = 64
MAX_FACES = 8
MAX_TEXT_REGIONS = 10
STRIP_HEIGHT = 224
STRIP_MIN = 56
STRIP_MAX = 672
MIN_GLYPH_PX = 8.0
CLIP_CHARS = 400

# Substrings that name a generator, in match order.
AI_MARKERS = [
    "dall-e", "dalle", "openai", "gpt-image", "sora",
    "midjourney", "stable diffusion", "stablediffusion", "sdxl", "sd-webui",
    "automatic1111", "comfyui", "invokeai", "novelai", "dreamstudio",
    "latent diffusion", "clipdrop", "firefly", "generative fill",
    "imagen", "gemini", "nano banana", "nanobanana", "deepdream",
    "flux", "black forest labs", "ideogram", "leonardo.ai", "playground ai",
    "recraft", "seedream", "seedance", "hidream", "kling", "runway", "luma ai",
    "grok", "craiyon", "nightcafe", "artbreeder", "dreamlike", "lensa",
    "picsart ai", "canva magic", "magic media", "remini",
    "ai generated", "ai-generated", "generative ai", "synthid",
    "trainedalgorithmicmedia", "compositewithtrainedalgorithmicmedia",
    "algorithmicmedia",
]

# Substrings that name a camera, in match order.
CAMERA_MARKERS = [
    "canon", "nikon", "sony", "fujifilm", "olympus", "panasonic", "leica",
    "pentax", "hasselblad", "phase one", "sigma fp",
    "iphone", "ipad", "apple", "samsung", "pixel", "xiaomi", "huawei",
    "oneplus", "oppo", "vivo", "motorola", "nothing phone",
    "gopro", "dji", "insta360", "ricoh",
]

# Substrings that name an editor, in match order.
EDITOR_MARKERS = [
    "photoshop", "lightroom", "camera raw", "gimp", "affinity", "capture one",
    "snapseed", "darktable", "rawtherapee", "paint.net", "pixelmator",
    "luminar", "dxo", "corel", "krita", "inkscape", "figma", "canva",
]

# PNG text keys whose presence alone names a generator.
PNG_GENERATOR_KEYS = {
    "parameters": "Stable Diffusion WebUI (AUTOMATIC1111)",
    "prompt": "ComfyUI",
    "workflow": "ComfyUI",
    "invokeai_metadata": "InvokeAI",
    "invokeai_graph": "InvokeAI",
    "sd-metadata": "InvokeAI (legacy)",
    "dream": "InvokeAI (legacy)",
}

# EXIF tag numbers that are reported, by name.
EXIF_TAGS = {
    0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0131: "Software",
    0x013B: "Artist", 0x013C: "HostComputer", 0x9286: "UserComment",
}

# XMP fields that are reported.
XMP_FIELDS = ["xmp:CreatorTool", "photoshop:Credit", "dc:creator", "Iptc4xmpExt:digitalSourceType", "Iptc4xmpExt:DigitalSourceType", "tiff:Software", "xmpMM:History"]
XMP_LONGEST = 400
# Name spaces of XMP and their customary prefixes.
XMP_SPACES = {
    "http://ns.adobe.com/xap/1.0/": "xmp", "http://ns.adobe.com/photoshop/1.0/": "photoshop", "http://purl.org/dc/elements/1.1/": "dc",
    "http://iptc.org/std/Iptc4xmpExt/2008-02-29/": "Iptc4xmpExt", "http://ns.adobe.com/tiff/1.0/": "tiff", "http://ns.adobe.com/xap/1.0/mm/": "xmpMM"}

# Sentences of the provenance summary.
SUMMARY_IPTC = (
    "the C2PA manifest asserts IPTC digitalSourceType = trainedAlgorithmicMedia, i.e. the "
    "generator itself declares this AI-generated. We do not validate the signature, so it "
    "remains an unvalidated claim"
)
SUMMARY_AI_HEAD = "the file declares AI involvement: "
SUMMARY_AI_TAIL = " (an unvalidated claim -- metadata is trivially forged)"
SUMMARY_C2PA = (
    "a C2PA manifest is present but we do not validate its signature; open it in Content "
    "Credentials to read the claim"
)
SUMMARY_CAMERA = (
    "the file declares a camera. Not proof it is real -- this field is as forgeable as any other"
)
SUMMARY_EDITOR = "the file declares an image editor. Neither signal on its own"
SUMMARY_METADATA = "metadata present, but nothing that names an origin"
SUMMARY_NONE = (
    "no metadata survives. Expected: every major platform strips it on upload, so absence is "
    "not evidence"
)
C2PA_PRESENT = "C2PA manifest present (signature not validated)"

# Sentences of the image report; the slots are branch, share and content.
EXPLAIN_AI = "The %s carried the strongest signal (%s) on this %s image."
EXPLAIN_REAL = "No branch found strong artifacts; the %s was most confident this is authentic (%s)."
EXPLAIN_UNSURE = (
    "Branches landed close to the decision boundary on this %s image -- treat this as low-confidence."
)
BRANCH_TITLES = ["general synthesis probe", "localized-edit probe", "face probe"]

# Weights and cuts of the reliability word.
RELIABILITY_DECISIVENESS = 0.6
RELIABILITY_AGREEMENT = 0.4
RELIABILITY_HIGH = 0.66
RELIABILITY_MEDIUM = 0.40

# Frames per second by clip length in seconds.
SAMPLING_RATES = [(60, 1), (120, 2), (300, 3)]
SAMPLING_RATE_LONG = 4

# Fixed value: pattern of readable runs in a manifest box.
PRINTABLE_RUN = r"[ -~]{6,120}"
MAX_CLAIMS = 6

# fixed value: usable rows after which an ingest must have seen every class
FIRST_LABELS = 300
