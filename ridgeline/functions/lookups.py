"""Constant lookup data.

FIXED VALUES: every literal in this module must equal what the original
application prints or matches, so results agree. They are listed plainly, in
their natural order; nothing here is derived.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — gender spellings (after upper-casing and trimming) and the
# class each maps to; anything else is 'U'.
# ---------------------------------------------------------------------------
GENDER_MAP = {
    "M": "M", "MALE": "M", "MAN": "M", "남": "M", "남성": "M",
    "F": "F", "FEMALE": "F", "WOMAN": "F", "W": "F", "여": "F", "여성": "F",
}
GENDER_UNKNOWN = "U"

# ---------------------------------------------------------------------------
# FIXED VALUES — area name -> (lat, lon), in lookup order. The order matters:
# the first key contained in an area name wins (a short key listed first hides
# a longer one).
# ---------------------------------------------------------------------------
AREA_COORDS = [
    ("서울", 37.5665, 126.9780), ("경기", 37.4138, 127.5183), ("인천", 37.4563, 126.7052),
    ("광명", 37.4784, 126.8643), ("안양", 37.3910, 126.9269), ("고양", 37.6584, 126.8320),
    ("일산", 37.6584, 126.8320),
    ("부천", 37.5034, 126.7660), ("시흥", 37.3801, 126.8031), ("안산", 37.3195, 126.8308),
    ("성남", 37.4200, 127.1265), ("분당", 37.3827, 127.1189), ("용인", 37.2410, 127.1775),
    ("수원", 37.2636, 127.0286), ("화성", 37.1995, 126.8315), ("남양주", 37.6360, 127.2165),
    ("구로", 37.4954, 126.8874), ("금천", 37.4565, 126.8954), ("관악", 37.4782, 126.9515),
    ("서울관악", 37.4782, 126.9515),
    ("동작", 37.5124, 126.9393), ("사당", 37.4765, 126.9816), ("영등포", 37.5264, 126.8962),
    ("마포", 37.5636, 126.9019), ("서대문", 37.5791, 126.9368), ("은평", 37.6027, 126.9291),
    ("강서", 37.5509, 126.8495), ("양천", 37.5169, 126.8660),
    ("강남", 37.5172, 127.0473), ("서초", 37.4837, 127.0324), ("송파", 37.5145, 127.1066),
    ("강동", 37.5301, 127.1238),
    ("노원", 37.6542, 127.0568), ("도봉", 37.6688, 127.0471), ("김포", 37.6152, 126.7157),
]
DEFAULT_COORD = (37.5665, 126.9780)

# ---------------------------------------------------------------------------
# FIXED VALUES — point milestones, checked from the highest down.
# ---------------------------------------------------------------------------
MILESTONES = [
    (100, "💯 특별시상"),
    (50, "🎫 50점 돌파"),
    (30, "🎫 30점 돌파"),
    (10, "🎫 10점 돌파"),
]

# ---------------------------------------------------------------------------
# FIXED VALUES — weekday names, Monday first.
# ---------------------------------------------------------------------------
WEEKDAY_NAMES = ["월", "화", "수", "목", "금", "토", "일"]

# ---------------------------------------------------------------------------
# FIXED VALUES — weather code classes, tested in this order.
# ---------------------------------------------------------------------------
SKY_CLEAR = "☀️"
SKY_CLOUDY_CODES = (1, 2, 3)
SKY_CLOUDY = "🌥️"
SKY_FOG_CODES = (45, 48)
SKY_FOG = "🌫️"
SKY_RAIN_CODES = (51, 53, 55, 61, 63, 65)
SKY_RAIN = "🌧️"
SKY_SNOW_CODES = (71, 73, 75, 77)
SKY_SNOW = "❄️"
SKY_STORM_MIN_CODE = 95
SKY_STORM = "⛈️"
SKY_OTHER = "🌡️"

# ---------------------------------------------------------------------------
# FIXED VALUES — display labels and badges.
# ---------------------------------------------------------------------------
YEAR_UNKNOWN = "??"
AREA_UNKNOWN = "미상"
YEAR_SUFFIX = "년"
AVATAR_URL_PREFIX = "https://ui-avatars.com/api/?name="
AVATAR_URL_SUFFIX = "&background=random"
AVATAR_DEFAULT_NAME = "Host"
BOARD_DEFAULT_NAME = "None"  # a missing name as the leaderboard prints it
BADGE_PREFIX = "D-"
BADGE_TODAY = "D-Day"
URGENT_DAYS = 3
ACTIVE_WINDOW_DAYS = 90
MEDALS = ["gold", "silver", "bronze"]
EVENT_LABEL_SEP = " | "

# ---------------------------------------------------------------------------
# FIXED VALUES — preferred column order of the two editable grids.
# ---------------------------------------------------------------------------
MEMBER_COLUMN_ORDER = [
    "birth_year", "name", "area", "role", "gender", "user_no", "phone",
    "description", "original_name", "point", "created_at", "last_attended",
    "profile_image_url",
]
ACTIVITY_COLUMN_ORDER = ["date", "title", "host", "event_id", "album_url", "description"]

# ---------------------------------------------------------------------------
# FIXED VALUES — monthly report text. "  " is a markdown line break.
# ---------------------------------------------------------------------------
BR = "  "
RULE = "────────────────"
RPT_RULES_HEAD = "🔗 **{club} 회칙 안내**"
RPT_TITLE = "⛰️ **{month} 활동 요약 보고서**"
RPT_ACTIVITY_HEAD = "📅 **[이달의 산행 기록]**"
RPT_ACTIVITY_LINE = "📍 {date} | {title}"
RPT_ATTENDEES = "└ 참석({n}명): "
RPT_ALBUM = "└ 📸 사진첩: "
RPT_NO_ACTIVITY = "활동 내역 없음"
RPT_AWARD_HEAD = "🏆 **[이달의 시상 현황]**"
RPT_AWARD_LINE = "✨ {label} ({points}점) {message}"
RPT_NONE_APPLICABLE = "해당사항 없음"
RPT_FIRST_HEAD = "🎉 **[첫 참석을 반겨요]**"
RPT_FIRST_LINE = "🎊 {name}님 (첫 참석 환영합니다!)"
RPT_NONE = "없음"
RPT_WARN_HEAD = "🚨 **[활동 관리 안내]**"
RPT_WARN_DORMANT = "😴 **장기 미참석(경고)**:"
RPT_WARN_NEW = "🌱 **신입 미참석(경고)**:"
RPT_SCORE_HEAD = "🔢 **[전체 회원 누적 점수 현황]**"
RPT_SCORE_COLUMNS = "| 회원명 | 이번달 점수 | 누적 점수 | 상태 |"
RPT_SCORE_ALIGN = "| :--- | ---: | ---: | :---: |"
RPT_SCORE_LINE = "| {label} | {gained}점 | {current}점 | {status} |"
RPT_CLOSING = "건강하게 다음 산행에서 뵙겠습니다! ⛰️"
BRIEFING_HEAD = "현재 날짜: {date}"
BRIEFING_LINE = "- 일정: {title} ({date}), 담당: {host}"

# ---------------------------------------------------------------------------
# FIXED VALUES — the characters that a full strip removes, as a regex class
# that Java's and RE2's engines read alike.
# ---------------------------------------------------------------------------
WHITE_SPACE = (r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
               r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
