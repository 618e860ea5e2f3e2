"""Small word lists for the queries over the test tables."""

POSITIVE = ["清", "明", "香", "晴", "暖", "醉", "笑", "歌", "早", "新"]
NEGATIVE = ["孤", "寒", "冷", "残", "枯", "泪", "愁", "霜", "暗", "掩"]
EMOTIONS = {
    "joy": {"暖": 1.0, "笑": 2.0, "歌": 1.0, "醉": 1.0},
    "grief": {"泪": 2.0, "残": 1.0, "枯": 1.0},
    "calm": {"闲": 1.0, "静": 1.0, "清": 0.5},
    "lonely": {"孤": 1.0, "寒": 1.0, "冷": 1.0},
}
#: The eight classes of an emotion vector.
EIGHT = EMOTIONS | {"anger": {"怒": 2.0, "恨": 1.0}, "fear": {"惊": 1.0, "危": 1.0}, "wonder": {"奇": 1.0}, "love": {"思": 1.0, "怜": 1.0}}
#: Terms of one to four characters with their finest class, and the two levels above it.
FEELINGS = {"暖": "joy", "笑": "joy", "歌": "joy", "醉歌": "joy", "清": "ease", "闲": "ease", "静": "ease", "清风": "ease", "香": "praise", "明": "praise", "新": "praise", "惊": "wonder", "奇": "wonder", "泪": "sorrow", "愁": "sorrow", "残": "sorrow", "枯": "sorrow", "残灯": "sorrow", "孤": "lonely", "寒": "lonely", "冷": "lonely", "孤灯": "lonely", "寒山": "lonely", "暗": "weary", "掩": "weary"}
PARENT = {"joy": "pleasure", "ease": "pleasure", "praise": "favour", "wonder": "surprise", "sorrow": "sadness", "lonely": "sadness", "weary": "disgust"}
POSITIVE_SIDE, NEGATIVE_SIDE = ["pleasure", "favour", "surprise"], ["sadness", "disgust"]
NEGATORS = ["不", "无", "莫", "未", "休", "勿"]
#: Fourteen single characters that count beside the two-character terms.
SINGLES = {"water": ["溪", "湖", "泉", "江", "潭"], "air": ["霜", "云", "霞", "烟", "风"], "house": ["楼", "窗", "桥", "门"]}
#: Two-character terms, each of one class.
CLASSES = {"water": ["溪云", "湖石", "泉声", "江水", "潭月"], "air": ["霜风", "云月", "霞雪", "寒烟", "雨风"], "house": ["楼台", "窗影", "桥帆", "门径", "帘灯"]}
#: Terms with a heading, of one to four characters.
HEADINGS = {"霜铃花": "花木", "月络兰": "花木", "烟缕菊": "花木", "雪绵莲": "花木", "星罗葵": "花木", "云": "天文", "月": "天文", "雪": "天文", "雨": "天文", "溪": "地理", "山": "地理", "湖": "地理", "江": "地理", "溪云": "地理", "寒山": "地理", "孤灯": "器物", "灯": "器物", "琴": "器物", "棋": "器物"}
HEADINGS |= {"春": "岁时", "秋": "岁时", "楼": "宫室", "窗": "宫室", "桥": "宫室", "客": "人事", "僧": "人事", "清": "品藻", "静": "品藻", "鹤": "禽虫", "燕": "禽虫", "蝉": "禽虫", "酒": "宴集", "棋声": "宴集", "书": "器物"}
#: The nine dimensions, each with the catalog categories that count for it.
DIMENSIONS = {"nature": ["天文", "地理"], "season": ["岁时"], "space": ["宫室"], "people": ["人事"], "virtue": ["品藻"], "artifact": ["器物"], "biota": ["禽虫"], "social": ["宴集"], "flower": ["花木"]}
#: Words of a query that point to a dimension.
DIMENSION_WORDS = {"nature": ["山", "水", "月"], "season": ["春", "秋", "时节"], "space": ["楼", "窗"], "people": ["友", "客", "老师"], "virtue": ["高洁", "清"], "artifact": ["琴", "灯"], "biota": ["鹤", "蝉"], "social": ["送别", "宴"], "flower": ["花", "赏菊"]}
#: Vectors over joy, grief, calm, lonely and none, by the name of a mood.
MOODS = {"思念": [0.1, 0.5, 0.2, 0.6, 0.1], "喜悦": [0.9, 0.0, 0.3, 0.0, 0.1]}
RULES = [
    {"label": "farewell", "triggers": ["送", "归", "别"], "patterns": ["送.{1,3}归"], "weight": 1.0},
    {"label": "landscape", "triggers": ["山", "湖", "溪", "江"], "patterns": ["[山湖]..[溪江]"], "weight": 0.5},
    {"label": "night", "triggers": ["月", "灯", "烛"], "patterns": ["月.*灯"], "weight": 0.8},
]
