"""Word lists, patterns and tables that rules are stated in.

Fixed values: the lists below decide results and are kept as they are.
"""

from __future__ import annotations

MEME_TAGS = ["meme", "memes", "memepage", "dankmemes", "dank", "shitpost", "funny", "funnyvideos", "humor", "humour", "comedy", "joke", "jokes", "lol", "lmao", "relatable", "fail", "мем", "меми", "мемы", "мемчики", "прикол", "приколы", "приколи", "жиза", "ржака", "юмор", "гумор", "шутка", "смешно", "смішно"]
MEME_ACCOUNT_HINTS = ["meme", "memes", "9gag", "humor", "humour", "funny", "lol", "prikol", "jokes", "comedy", "shitpost", "dank", "мем", "прикол"]
ART_TAGS = ["art", "artist", "artwork", "digitalart", "illustration", "illustrator", "drawing", "painting", "sketch", "conceptart", "characterdesign", "3d", "3dart", "3dartist", "cgi", "cg", "render", "rendering", "blender", "c4d", "cinema4d", "houdini", "octane", "redshift", "unreal", "vfx", "animation", "motion", "motiondesign", "motiongraphics", "graphicdesign", "design", "typography", "branding", "editorial", "photography", "photographer", "portrait", "cinematography", "architecture", "interior", "product", "aiart", "midjourney", "generative", "creativecoding", "арт", "дизайн", "ілюстрація", "иллюстрация", "анімація", "анимация", "рендер", "типографіка", "фотографія", "архітектура"]
ART_ACCOUNT_HINTS = ["studio", "studios", "art", "arts", "artist", "design", "designs", "designer", "motion", "visual", "visuals", "creative", "cgi", "3d", "film", "films", "atelier", "graphics", "render", "photo", "photography"]
AD_TAGS = ["ad", "ads", "advert", "advertising", "sponsored", "paidpartnership", "promo", "promotion", "commercial", "campaign", "brand", "branded", "collab", "реклама", "рекламa", "промо", "кампанія", "кампания"]
AD_PHRASES = ["paid partnership", "sponsored by", "in partnership with", "#ad", "у співпраці", "рекламний", "рекламная", "at замовлення"]

HASHTAG = "#([0-9A-Za-z_Ѐ-ӿÀ-ɏ]{2,40})"
RATE_MARKS = ["pleasewaitfewminutes", "please wait", "rate limit", "ratelimit", "429", "feedback_required", "feedbackrequired", "too many"]
SESSION_MARKS = ["loginrequired", "login_required", "challengerequired", "challenge_required", "checkpoint", "sessionid", "not logged in"]
TUTORIAL_MARKS = ["tut", "tutorial", "howto", "how-to", "lesson", "breakdown", "houdini", "blender", "c4d", "cinema4d", "unreal", "nuke", "substance", "zbrush", "maya", "after-effects", "ae "]
CATEGORIES = ["meme", "art", "ad", "game", "other"]
MEDIUMS = ["live-action", "3d-render", "2d-animation", "motion-graphics", "stop-motion", "screen-recording", "illustration", "photograph", "graphic-design", "mixed-media"]
MARKER = "autotagged"

SOFTWARE = r"blender|houdini|cinema ?4d|c4d|after ?effects|\bae\b|premiere|davinci|nuke|unreal|unity|zbrush|substance|touchdesigner|figma|photoshop|illustrator|lightroom|maya|3ds ?max|marvelous|midjourney|comfyui|runway"
USEFUL_RULES = {
    "resource-list": r"\b\d+\s*(?:/\s*\d+)?\s+(?:\w+\s+){0,2}(?:websites?|sites?|tools?|apps?|resources?|plugins?|scripts?|fonts?|assets?|prompts?|extensions?|channels?|accounts?)\b|\b(?:websites?|tools?|resources?|plugins?|apps?)\s+(?:for|every|you|i use|that)\b|\buse these instead\b|\bhere are\b|\bmy go-?to\b|\balternatives?\b|\bcheat ?sheet\b|\bпідбірк|\bсайт(?:и|ів)\b|\bінструмент(?:и|ів)\b",
    "tutorial": r"\bhow (?:to|i)\b|\btutorial\b|\btut\b|\bstep \d\b|\bhere'?s how\b|\bguide\b|\bwalk-?through\b|\blesson\b|\bкак сделать\b|\bяк зробити\b|\bурок\b|\bтуторіал\b",
    "tips": r"\btips?\b|\btricks?\b|\bhacks?\b|\bshortcuts?\b|\bstop (?:using|doing|making)\b|\bmistakes?\b|\bpro tip\b|\bnever\b.{0,20}\bagain\b|\bлайфхак\b|\bпорад",
    "workflow-breakdown": r"\bbreakdown\b|\bworkflow\b|\bhow (?:i|we) (?:made|built|did)\b|\bnode setup\b|\bpipeline\b|\bрозбір\b",
    "explainer": r"\bexplained\b|\bwhat is\b|\bwhy\b.{0,24}\b(?:matters|works)\b|\bthe difference between\b",
    "prompt-share": r"\bprompts?\b|\bпромпт",
    "news-drop": r"\bjust (?:released|dropped|launched|added)\b|\bis out now\b|\bnew (?:update|feature|version|model)\b|\bv\d+(?:\.\d+)? is here\b",
    "course-promo": r"\bcourse\b|\bmasterclass\b|\bwebinar\b|\bfree training\b|\bкурс\b",
    "link-in-bio": r"\blinks? in (?:bio|the description)\b|\bdm me\b|\bsave this\b|\bbookmark this\b|\bcomment\b[^.]{0,60}\b(?:send|get|dm|link)\b|\bпосилання в (?:біо|шапці)\b",
}
CONTENT_TAGS = ["resource-list", "tutorial", "tips", "workflow-breakdown", "explainer", "prompt-share", "news-drop", "software-tip"]

SOFTWARE_TAGS = ["blender", "houdini", "cinema-4d", "maya", "3ds-max", "unreal-engine", "unity", "after-effects", "nuke", "davinci-resolve", "premiere", "redshift", "octane", "arnold", "vray", "substance", "zbrush", "marvelous-designer", "touchdesigner", "notch", "embergen", "comfyui", "stable-diffusion", "midjourney", "runway", "kling", "sora", "veo", "flux", "photoshop", "illustrator", "figma"]
SOFTWARE_ALIASES = {"b3d": "blender", "c4d": "cinema-4d", "cinema4d": "cinema-4d", "ae": "after-effects", "aftereffects": "after-effects", "ue5": "unreal-engine", "ue4": "unreal-engine", "unreal": "unreal-engine", "resolve": "davinci-resolve", "davinci": "davinci-resolve", "sd": "stable-diffusion", "mj": "midjourney", "3dsmax": "3ds-max", "touch-designer": "touchdesigner", "ps": "photoshop"}
AMBIGUOUS_SOFTWARE = ["ae", "sd", "mj", "ps", "resolve", "unity", "runway", "flux", "notch", "arnold", "maya", "octane", "substance", "nuke", "davinci"]
SOFTWARE_PHRASES = {"v ray": "vray", "octane render": "octane", "touch designer": "touchdesigner", "substance painter": "substance", "substance designer": "substance", "unreal engine 5": "unreal-engine", "stable diffusion": "stable-diffusion", "cinema 4d": "cinema-4d", "marvelous designer": "marvelous-designer", "3ds max": "3ds-max", "after effects": "after-effects", "davinci resolve": "davinci-resolve", "unreal engine": "unreal-engine", "premiere pro": "premiere"}

PROFILE_ORDER = ["core", "live", "3d", "2d", "motion", "graphic"]
MEDIUM_PROFILES = {"live-action": ["core", "live"], "photograph": ["core", "live"], "3d-render": ["core", "3d", "live"], "stop-motion": ["core", "3d", "live"], "2d-animation": ["core", "2d"], "illustration": ["core", "2d"], "motion-graphics": ["core", "motion", "graphic"], "screen-recording": ["core", "motion", "graphic"], "graphic-design": ["core", "graphic"]}
UNKNOWN_MEDIUM_PROFILES = ["core", "live", "3d", "motion"]
WORDS_3D = r"\b(?:3d|renders?|rendered|rendering|cgi|blender|houdini|c4d)\b"
WORDS_GRAPHIC = r"\b(?:logos?|typography|posters?|branding)\b"

EXCLUSIVE = [["high-key", "low-key"], ["hard-light", "soft-light"], ["handheld", "locked-off"], ["slow-motion", "time-lapse"], ["talking-head", "faceless"], ["day", "night-scene"]]
IGNORED_TAGS = ["cinematic", "cinematic-look", "meme", "art", "ad", "game", "other", "fantasy", "sci-fi", "indoor", "outdoor", "screen", "computer", "monitor", "display"]
MODE_ALIASES = {
    "image": {"3d-render": "3d-render", "cgi": "3d-render", "3d-animation": "3d-render", "3d": "3d-render", "render": "3d-render", "cgi-render": "3d-render", "cgi-animation": "3d-render", "fashion": "model"},
    "video": {"3d-render": "3d-render", "cgi": "3d-render", "3d-animation": "3d-render", "3d": "3d-render", "render": "3d-render", "cgi-render": "3d-render", "cgi-animation": "3d-render", "fashion": "fashion-film"},
}

#: A starter vocabulary: category, limit, mode, profiles, tags. A library's own comes as a vocabulary file (sources.vocabulary).
STARTER_CATEGORIES = [
    ("lighting_quality", 2, "both", "core", "hard-light, soft-light, high-key, low-key"),
    ("lighting_direction", 2, "both", "core", "top-light, side-light, backlit, rim-light"),
    ("lighting_source", 2, "both", "core", "golden-hour, blue-hour, neon-lit"),
    ("color", 2, "both", "core", "warm-tones, cool-tones, monochromatic"),
    ("frame_size", 2, "both", "core", "close-up, medium-shot, wide-shot"),
    ("camera_angle", 2, "both", "core", "low-angle, high-angle, overhead"),
    ("format", 1, "both", "core", "vertical, square, letterbox"),
    ("mood", 2, "both", "core", "dramatic, calm, playful"),
    ("genre", 2, "both", "core", "commercial, fashion-film, tutorial"),
    ("movement", 2, "video", "live", "handheld, locked-off, orbit, crane"),
    ("editing", 2, "video", "live", "slow-motion, time-lapse"),
    ("subject", 2, "both", "core", "portrait, architecture, interior"),
    ("people", 2, "image", "live", "model, talking-head, faceless"),
    ("action", 2, "both", "live", "sport-action, dance"),
    ("medium", 1, "both", "core", "3d-render, illustration, photograph"),
    ("useful", 4, "both", "core", "useful, tutorial, tips, resource-list, workflow-breakdown, explainer, prompt-share, news-drop, course-promo, link-in-bio, software-tip"),
    ("software", 4, "both", "hidden", ", ".join(SOFTWARE_TAGS)),
]
STARTER_ALIASES = {"skiing": "sport-action", "dancing": "dance", "backlight": "backlit", "photography": "photograph", **SOFTWARE_ALIASES}
