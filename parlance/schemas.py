"""Schemas of the tables that the engine reads and writes, as DDL."""

MESSAGE = "struct<role:string,content:string>"
TURN_PAIR = "struct<user:string,assistant:string>"
CHAT = "struct<`from`:string,value:string>"

DAILY_DIALOG = "UID string, DID string, SID string, SEG string, EMOTION string"
RAW_GENERATION = f"PROMPT array<{MESSAGE}>, GENERATION_ID string, COMPLETION string, TOPIC string, EMOTIONS array<struct<h:string,c:string>>"
SEGMENTS = (
    "UID string, DIALOGUE_ID string, SID string, SEG string, EMOTION array<string>, TOPIC string, EXPLANTATION string, "
    "RESPONSE_1 string, RESPONSE_2 string, RESPONSE_3 string, EMOTION_RESPONSE_1 string, EMOTION_RESPONSE_2 string, EMOTION_RESPONSE_3 string"
)
TURNS = SEGMENTS.replace("SEG string", "PROMPT string") + ", COMPLETION string"
DIALOGUE_RECORD = f"system string, history array<{TURN_PAIR}>, instruction string, input string, output string, dialogue_id string, `set` string"
PREDICTIONS = "pos bigint, prompt string, predict string, label string"
REWARD_PREDICTIONS = "chosen double, rejected double"
COMPARISON_RESULTS = f"dialogue_id string, `set` string, instruction string, history array<{TURN_PAIR}>, prompt string, target string, candidates array<string>, model string"
COMPARISON_JOINED = "dialogue_id string, target string, candidates array<struct<name:string,text:string,emb:array<float>>>, scores array<double>, modified string, modified_label string"
RATINGS = "DIALOGUE_ID string, judge string, PROMPT string, COMPLETION string, EMOTIONS struct<h:string,c:string>, EXPRESSION_LEVEL array<int>, MODIFIED boolean"
RANKS = "DIALOGUE_ID string, RANK array<int>, MODIFIED boolean"
PAIRS = "DIALOGUE_ID string, WINNER int, LOSER int"
PREFERENCE_FINAL = f"conversations array<{CHAT}>, chosen {CHAT}, rejected {CHAT}, preference_id string, dialogue_id string, `set` string"
ALIGNED = f"_prompt array<{MESSAGE}>, _response array<{MESSAGE}>, _system string, _tools string, _images array<string>, _videos array<string>, _audios array<string>"
TOKENS = "input_ids array<int>, attention_mask array<int>, labels array<int>"
FEEDBACK = f"messages array<{MESSAGE}>, label boolean"
MCQ = "question string, A string, B string, C string, D string, answer string"
TRAINER_LOG = (
    "current_steps int, total_steps int, loss double, eval_loss double, predict_loss double, reward double, accuracy double, lr double, "
    "epoch double, percentage double, elapsed_time string, remaining_time string, throughput double, total_tokens bigint"
)

#: Order in which the sets of dialogues stand in merged files.
SET_ORDER = ("sft-demonstration", "rm-prompt", "ppo-unlabeled-prompts")
#: First dialogue number of each stage.
STAGE_OFFSET = {"sft": 0, "rm": 978, "ppo": 1978}
#: Label that losses ignore.
IGNORE = -100
