"""Words of queries and attributes, and what they stand for. The tables must equal those that data and users bring along."""

from __future__ import annotations

PLATE = "苏[E-Z][A-Z0-9]{5}"

#: Words of target types, in the order in which they are looked for.
TARGET_WORDS = {
    "non_motor_vehicle": ["电动车", "自行车", "摩托车", "非机动车"],
    "pedestrian": ["行人", "男人", "女人", "男性", "女性", "男的", "女的"],
    "vehicle": ["轿车", "SUV", "卡车", "面包车", "出租车", "公交车", "车辆", "车"],
}

#: Colour words.
COLOUR_WORDS = {
    "白色": "白色", "白": "白色", "黑色": "黑色", "黑": "黑色", "银色": "银色", "银灰": "银色", "灰色": "灰色", "灰": "灰色",
    "红色": "红色", "红": "红色", "蓝色": "蓝色", "蓝": "蓝色", "深蓝": "蓝色", "浅蓝": "蓝色", "绿色": "绿色", "绿": "绿色",
    "黄色": "黄色", "黄": "黄色", "橙色": "橙色", "橙": "橙色", "棕色": "棕色", "棕": "棕色", "粉色": "粉色", "粉": "粉色",
}

#: Vague colours and the colours they may mean.
VAGUE_COLOURS = {
    "深色": ["黑色", "灰色", "棕色", "蓝色"],
    "暗色": ["黑色", "灰色", "棕色"],
    "浅色": ["白色", "黄色", "粉色", "金色"],
    "亮色": ["白色", "红色", "黄色", "橙色", "粉色", "金色"],
    "金属色": ["银色", "灰色", "金色"],
    "暖色": ["红色", "橙色", "黄色", "棕色", "金色", "粉色"],
    "冷色": ["蓝色", "绿色", "灰色", "黑色", "紫色"],
    "暗": ["黑色", "灰色", "棕色"],
    "亮": ["白色", "红色", "黄色"],
}

#: Colour aliases of attributes.
COLOUR_ALIASES = {
    "米白": "白色", "乳白": "白色", "象牙白": "白色", "深灰": "灰色", "浅灰": "灰色", "银灰": "银色", "深红": "红色", "粉红": "粉色", "浅粉": "粉色",
    "枣红": "红色", "深蓝": "蓝色", "浅蓝": "蓝色", "天蓝": "蓝色", "藏蓝": "蓝色", "宝蓝": "蓝色", "浅绿": "绿色", "深绿": "绿色", "草绿": "绿色",
    "墨绿": "绿色", "金色": "黄色", "淡黄": "黄色", "浅黄": "黄色", "橘色": "橙色", "褐色": "棕色", "咖啡色": "棕色", "深棕": "棕色", "浅棕": "棕色",
}

#: Colours that also match a colour, beside itself.
NEAR_COLOURS = {"白色": ["乳白"], "银色": ["银灰"]}

#: Type words of queries: aliases, exact words, and words for several types.
TYPE_ALIASES = {
    "微面": "面包车", "面包车": "面包车", "小面": "面包车", "大货": "卡车", "大卡车": "卡车", "重型货车": "卡车", "小货": "卡车", "小卡车": "卡车",
    "轻型货车": "卡车", "吉普": "SUV", "越野": "SUV", "越野车": "SUV", "私家车": "轿车", "家用轿车": "轿车", "轿车": "轿车", "面的": "面包车",
    "大巴": "公交车", "公交": "公交车", "中巴": "公交车", "拖头": "卡车", "集装箱": "卡车", "三轮": "三轮车", "摩的": "摩托车", "两厢车": "轿车",
}
TYPE_GROUPS = {"大车": ["卡车", "公交车"], "大家伙": ["卡车", "公交车"], "小车": ["轿车", "SUV", "跑车"], "货车": ["卡车"], "客车": ["公交车"]}
TYPE_WORDS = {"轿车": "轿车", "SUV": "SUV", "suv": "SUV", "卡车": "卡车", "货车": "卡车", "面包车": "面包车", "出租车": "出租车", "公交车": "公交车", "跑车": "跑车"}

#: Type aliases of attributes, and the types that also match a type.
TYPE_NAMES = {
    "吉普车": "SUV", "越野车": "SUV", "货车": "卡车", "拖头": "卡车", "大卡车": "卡车", "小货车": "卡车", "大巴": "公交车", "公共汽车": "公交车",
    "的士": "出租车", "小轿车": "轿车", "三轮": "三轮车", "三蹦子": "三轮车", "拖拉机": "三轮车", "电驴": "电动车", "小电驴": "电动车", "摩托": "摩托车",
    "重型货车": "卡车", "轻型货车": "卡车", "微型货车": "卡车", "大型客车": "公交车", "中型客车": "公交车", "小型客车": "面包车", "微面": "面包车",
}
TYPE_RELATED = {"轿车": ["轿车", "两厢车"], "两厢车": ["轿车", "两厢车"]}
NON_MOTOR_TYPES = ["三轮车", "电动车", "自行车", "摩托车"]

BAG_WORDS = ["背包", "书包", "挎包", "手提包"]
ACCESSORY_WORDS = {"帽子": ["帽子", "头盔"], "眼镜": ["眼镜", "墨镜"]}

#: Colloquial phrases, each with its target type and the attributes that it states.
PHRASES: dict[str, tuple[str, dict[str, str]]] = {
    "小轿车": ("vehicle", {"vehicle_type": "轿车"}),
    "轿车": ("vehicle", {"vehicle_type": "轿车"}),
    "两厢车": ("vehicle", {"vehicle_type": "轿车"}),
    "私家车": ("vehicle", {"vehicle_type": "轿车"}),
    "家用轿车": ("vehicle", {"vehicle_type": "轿车"}),
    "越野车": ("vehicle", {"vehicle_type": "SUV"}),
    "SUV": ("vehicle", {"vehicle_type": "SUV"}),
    "suv": ("vehicle", {"vehicle_type": "SUV"}),
    "吉普车": ("vehicle", {"vehicle_type": "SUV"}),
    "吉普": ("vehicle", {"vehicle_type": "SUV"}),
    "越野": ("vehicle", {"vehicle_type": "SUV"}),
    "面包车": ("vehicle", {"vehicle_type": "面包车"}),
    "小面": ("vehicle", {"vehicle_type": "面包车"}),
    "微面": ("vehicle", {"vehicle_type": "面包车"}),
    "小型客车": ("vehicle", {"vehicle_type": "面包车"}),
    "面的": ("vehicle", {"vehicle_type": "面包车"}),
    "小货车": ("vehicle", {"vehicle_type": "卡车"}),
    "货车": ("vehicle", {"vehicle_type": "卡车"}),
    "大卡车": ("vehicle", {"vehicle_type": "卡车"}),
    "拖头": ("vehicle", {"vehicle_type": "卡车"}),
    "大货": ("vehicle", {"vehicle_type": "卡车"}),
    "集装箱": ("vehicle", {"vehicle_type": "卡车"}),
    "truck": ("vehicle", {"vehicle_type": "卡车"}),
    "大巴": ("vehicle", {"vehicle_type": "公交车"}),
    "大巴车": ("vehicle", {"vehicle_type": "公交车"}),
    "公交车": ("vehicle", {"vehicle_type": "公交车"}),
    "中巴": ("vehicle", {"vehicle_type": "公交车"}),
    "公交": ("vehicle", {"vehicle_type": "公交车"}),
    "bus": ("vehicle", {"vehicle_type": "公交车"}),
    "的士": ("vehicle", {"vehicle_type": "出租车"}),
    "出租车": ("vehicle", {"vehicle_type": "出租车"}),
    "皮卡": ("vehicle", {"vehicle_type": "皮卡"}),
    "房车": ("vehicle", {"vehicle_type": "RV"}),
    "car": ("vehicle", {}),
    "蓝车": ("vehicle", {"color": "蓝色"}),
    "红车": ("vehicle", {"color": "红色"}),
    "白车": ("vehicle", {"color": "白色"}),
    "黑车": ("vehicle", {"color": "黑色"}),
    "蓝色的士": ("vehicle", {"color": "蓝色", "vehicle_type": "出租车"}),
    "白色的士": ("vehicle", {"color": "白色", "vehicle_type": "出租车"}),
    "白色面包车": ("vehicle", {"color": "白色", "vehicle_type": "面包车"}),
    "黑色轿车": ("vehicle", {"color": "黑色", "vehicle_type": "轿车"}),
    "蓝色轿车": ("vehicle", {"color": "蓝色", "vehicle_type": "轿车"}),
    "白色小轿车": ("vehicle", {"color": "白色", "vehicle_type": "轿车"}),
    "红色大巴": ("vehicle", {"color": "红色", "vehicle_type": "公交车"}),
    "白色货车": ("vehicle", {"color": "白色", "vehicle_type": "卡车"}),
    "红色大车": ("vehicle", {"color": "红色", "vehicle_type": "卡车"}),
    "蓝色的SUV": ("vehicle", {"color": "蓝色", "vehicle_type": "SUV"}),
    "黑色越野车": ("vehicle", {"color": "黑色", "vehicle_type": "SUV"}),
    "三轮": ("non_motor_vehicle", {"vehicle_type": "三轮车"}),
    "三轮车": ("non_motor_vehicle", {"vehicle_type": "三轮车"}),
    "三蹦子": ("non_motor_vehicle", {"vehicle_type": "三轮车"}),
    "拖拉机": ("non_motor_vehicle", {"vehicle_type": "三轮车"}),
    "电驴": ("non_motor_vehicle", {"vehicle_type": "电动车"}),
    "小电驴": ("non_motor_vehicle", {"vehicle_type": "电动车"}),
    "电动车": ("non_motor_vehicle", {"vehicle_type": "电动车"}),
    "摩托": ("non_motor_vehicle", {"vehicle_type": "摩托车"}),
    "摩托车": ("non_motor_vehicle", {"vehicle_type": "摩托车"}),
    "摩的": ("non_motor_vehicle", {"vehicle_type": "摩托车"}),
    "自行车": ("non_motor_vehicle", {"vehicle_type": "自行车"}),
    "男的": ("pedestrian", {"gender": "male"}),
    "男士": ("pedestrian", {"gender": "male"}),
    "男人": ("pedestrian", {"gender": "male"}),
    "女的": ("pedestrian", {"gender": "female"}),
    "小姐": ("pedestrian", {"gender": "female"}),
    "女人": ("pedestrian", {"gender": "female"}),
    "蓝衣服": ("pedestrian", {"clothing_color": "蓝色"}),
    "红衣服": ("pedestrian", {"clothing_color": "红色"}),
    "白衣服": ("pedestrian", {"clothing_color": "白色"}),
    "黑衣服": ("pedestrian", {"clothing_color": "黑色"}),
    "穿蓝色衣服的人": ("pedestrian", {"clothing_color": "蓝色"}),
    "穿红色衣服的人": ("pedestrian", {"clothing_color": "红色"}),
    "背红色书包的女人": ("pedestrian", {"gender": "female", "bag": "true", "bag_color": "红色"}),
    "背书包的人": ("pedestrian", {"bag": "true"}),
    "戴帽子的人": ("pedestrian", {"accessory": "帽子"}),
    "戴眼镜的人": ("pedestrian", {"accessory": "眼镜"}),
    "黑裤子男人": ("pedestrian", {"gender": "male", "pants_color": "黑色"}),
    "白衣服女人": ("pedestrian", {"gender": "female", "clothing_color": "白色"}),
}

#: Words of the short parser: colours (the first that holds a word wins), types and lane directions (the longest word wins).
SHORT_COLOURS = {"白色": ["白", "white"], "黑色": ["黑", "black"], "红色": ["红", "red"], "蓝色": ["蓝", "blue"], "绿色": ["绿", "green"], "黄色": ["黄", "yellow"], "灰色": ["灰", "gray", "grey"], "棕色": ["棕", "brown"], "银色": ["银", "silver"]}
SHORT_TYPES = {"轿车": ["轿", "sedan", "car"], "SUV": ["suv", "越野"], "卡车": ["卡", "truck", "货"], "面包车": ["面包", "van"], "跑车": ["跑", "sports"], "两厢车": ["两厢", "hatchback"], "MPV": ["mpv", "商务"], "皮卡": ["皮卡", "pickup"]}
LANE_WORDS = {
    "northbound": ["由南向北", "南向北", "向北", "北向", "朝北", "northbound"],
    "southbound": ["由北向南", "北向南", "向南", "南向", "朝南", "southbound"],
    "eastbound": ["由西向东", "西向东", "向东", "东向", "朝东", "eastbound"],
    "westbound": ["由东向西", "东向西", "向西", "西向", "朝西", "westbound"],
}

OPPOSITE_LANES = {"eastbound": "westbound", "westbound": "eastbound", "northbound": "southbound", "southbound": "northbound"}
LANE_ANGLES = {
    "eastbound": 90.0, "westbound": 270.0, "northbound": 0.0, "southbound": 180.0, "east": 90.0, "west": 270.0, "north": 0.0, "south": 180.0, "northeast": 45.0, "northwest": 315.0,
    "southeast": 135.0, "southwest": 225.0, "east-west": 90.0, "north-south": 0.0, "northeast-southwest": 45.0, "northwest-southeast": 315.0,
}

#: Class numbers of the detector, and type and colour codes of the data.
DETECTOR_CLASSES = {0: "pedestrian", 1: "non_motor_vehicle", 2: "vehicle", 3: "non_motor_vehicle", 5: "vehicle", 7: "vehicle"}
COLOUR_CODES = {0: "黄色", 1: "橙色", 2: "绿色", 3: "灰色", 4: "红色", 5: "蓝色", 6: "白色", 7: "金色", 8: "棕色", 9: "黑色", 10: "紫色", 11: "粉色"}
TYPE_CODES = {0: "轿车", 1: "SUV", 2: "面包车", 3: "两厢车", 4: "MPV", 5: "皮卡", 6: "公交车", 7: "卡车", 8: "旅行车", 9: "跑车", 10: "房车"}
SIZE_WORDS = {"large": "大型", "medium": "中型", "small": "小型"}
TARGET_NAMES = {"vehicle": "机动车", "pedestrian": "行人", "non_motor_vehicle": "非机动车"}

#: States of a query session as users read them.
STATE_NAMES = {"searched": "检索", "confirmed": "确认", "backtracked": "回溯", "excluded": "排除", "suspect": "存疑", "idle": "空闲"}
