"""Patterns and word lists, the same text for both engines (Java and RE2 syntax)."""

from __future__ import annotations

# What counts as white space.
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
STRIP = f"^{SPACE}+|{SPACE}+$"
# Marks that don't count when texts are compared by hash.
HASH_DROPPED = SPACE[:-1] + r".,!?~\-·…『』「」()\[\]{}'\"]+"
VERSION_ENDINGS = r"(_v[0-9]+)+$"

# Rule word lists. They differ between rules on purpose.
PHOTO_WORDS = ["사진", "보여주", "보내주", "이미지", "촬영"]
PHOTO_REQUESTS = ["사진", "보여주", "보내주"]
FORBIDDEN_WORDS = ["설문", "조사", "서베이"]
TONE_FORBIDDEN = ["설문", "조사", "서베이", "테스트", "실험"]
FORCEFUL_WORDS = ["꼭", "반드시", "무조건", "해야", "드셔야"]
EMPATHY_WORDS = ["이해", "공감", "그렇", "맞", "좋", "중요", "멋지", "대단", "다행", "응원", "소중", "인상적", "재미", "흥미", "편안", "부담", "어려", "힘드", "아쉽", "노력"]

# Emoji ranges, wide for cleaning and narrow for scoring.
EMOJI_WIDE = r"[\x{1F600}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{2600}-\x{26FF}\x{2700}-\x{27BF}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{200D}\x{FE0F}]+"
EMOJI_NARROW = r"[\x{1F600}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{2600}-\x{26FF}]"
GREETING = rf"^안녕하세요[!.]?{SPACE}*\x{{1F60A}}?{SPACE}*"

# Polite endings by rule.
_ENDS = r"(?:[^\pL\pN_]|$)"
HONORIFIC_FULL = r"(?:요|세요|네요|습니다|겠어요|드려요|죠|지요|군요|이에요|예요|인가요|나요|할까요|볼까요|실까요|던가요|합니다|됩니다|랍니다)" + _ENDS
HONORIFIC_RESPONSE = r"(?:요|세요|네요|습니다|겠어요|죠|지요|군요|이에요|예요|나요)" + _ENDS
HONORIFIC_RETRY = r"(?:요|세요|네요|습니다|겠어요|죠|지요|나요)" + _ENDS
HONORIFIC_REPHRASE = r"(?:요|세요|네요|습니다|겠어요|죠|지요|나요|인가요|할까요|볼까요|실까요|던가요)" + _ENDS
KEYWORD = r"[가-힣]{2,}"
THINK = r"(?s)<think>.*?</think>"

TASKS = ["intro", "first_question", "retry", "ending", "title", "response"]
