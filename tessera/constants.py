"""Fixed values that must equal the source project's for right results.

FIXED VALUES — special tokens, token ids, the label ignore index, geometry of
the vision tower, system prompts, the action vocabulary and the text-only
prompt pool.  They are stated here once, in natural order, and used
everywhere else by name.
"""

# --- FIXED VALUES: chat template pieces -----------------------------------
BOS = "[@BOS@]"
START_OF_TURN = "<|start_of_turn|>"
END_OF_TURN = "<|end_of_turn|>"
IMAGE_SOFT_TOKEN = "<|image_soft_token|>"
START_OF_IMAGE = "<|start_of_image|>"
END_OF_IMAGE = "<|end_of_image|>"
IMAGE_PLACEHOLDER = "<image>"

# --- FIXED VALUES: token ids and sentinels --------------------------------
BOS_ID = 2
IMAGE_TOKEN_ID = 8
IMAGE_START_ID = 255999
IMAGE_END_ID = 256000
IGNORE_INDEX = -100
RESERVED_IDS = 16          # ids 0..15 are reserved in the built-in vocabulary

# --- FIXED VALUES: vision geometry ----------------------------------------
PATCH_SIZE = 16
SPATIAL_MERGE = 2
TARGET_SIZE = 672
VISION_DIM = 4096
FP16_BYTES = 2

# --- FIXED VALUES: defaults of the loaders ---------------------------------
DEFAULT_HUMAN_PROMPT = "Describe this image."
MAX_SAMPLES_PER_CONFIG = 50000
DEFAULT_SHARD_SIZE = 1000

# --- FIXED VALUES: action vocabulary and examples --------------------------
ACTION_TYPES = ["click", "type", "scroll", "drag", "long_press", "done"]

# --- FIXED VALUES: system prompts by task ----------------------------------
GROUNDING_SYSTEM_PROMPT = """You are a GUI agent that can interact with screen interfaces. When given a screenshot and a task, output the precise action to take.

Actions use normalized [0,1] coordinates relative to the screenshot:
click(x=0.45, y=0.72)
type(text="search query")
scroll(direction="down")
drag(startX=0.1, startY=0.2, endX=0.5, endY=0.8)
long_press(x=0.3, y=0.5)
done()"""

AGENTIC_SYSTEM_PROMPT = """You are a GUI agent that plans and executes multi-step tasks on screen interfaces. For each step:
1. Observe the screenshot
2. Think about what to do next in <think>...</think> tags
3. Output the action to take

Actions use normalized [0,1] coordinates relative to the screenshot:
click(x=0.45, y=0.72)
type(text="search query")
scroll(direction="down")
drag(startX=0.1, startY=0.2, endX=0.5, endY=0.8)
done()"""

# --- FIXED VALUES: text-only prompt pool for mixing -------------------------
TEXT_PROMPT_POOL = [
    ("Explain quantum computing in simple terms.", "Quantum computing uses quantum bits or qubits..."),
    ("What is photosynthesis?", "Photosynthesis is the process by which plants convert sunlight..."),
    ("Describe the water cycle.", "The water cycle involves evaporation, condensation, precipitation..."),
    ("What causes earthquakes?", "Earthquakes are caused by the movement of tectonic plates..."),
    ("How does the internet work?", "The internet is a global network of computers connected..."),
]

# --- FIXED VALUES: request routing words -----------------------------------
QUIT_WORDS = ["quit", "exit", "q"]
TEXT_MODE_WORD = "text"
