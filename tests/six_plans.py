"""Six hand-worked plans, shared by fixtures and figures; a name of its own, so that no conftest has to be imported."""

PLAN_SCHEMA = (
    "_row bigint, owner_company_name string, owner_office_number string, camp_label string, allocated_haj double, "
    "number_of_haj double, number_of_buses double, plan_type_code string, plan_type_name string, transport_type_name string, "
    "period string, entrance_name string, entrance_asm_code string, path_name string, start_point_type string, "
    "start_point_name string, end_point_type string, end_point_name string, start_point_district string, plan_id string")

A, A2, B = "شركة مكه", "شركة مكة ", "يسر"
ROWS = [
    (1, A, "11", "1/608", 100.0, 40.0, 2.0, "tarwia", "تروية", "ترددي", "1", "E1", None, "R1", "residence", "H1", "camp", "C1", "حى الزهراء", "p1"),
    (2, A2, "11", "1/608", 120.0, 50.0, 3.0, "tarwia", "تروية", "تقليدي رد", "1", "E1", None, "R2", "residence", "H1", "camp", "C1", "حي الزهراء", "p2"),
    (3, A, "11", "1/608", 90.0, 30.0, 1.0, "direct_taseed", "تصعيد مباشر", "تقليدي ردين", "2", "E2", None, "R1", "residence", "H2", "camp", "C1", None, "p3"),
    (4, B, "7", "C/206", 60.0, 60.0, 4.0, "efada", "إفاضة", "قطار", "10", None, "X9", None, "camp", "C2", "residence", "H2", None, "p4"),
    (5, B, "7", None, 25.0, 10.0, 1.0, "taseed_tarwia", "تصعيد تروية", None, "2", None, None, "R2", "residence", "H3", "camp", "C2", "حي كدي", "p5"),
    (6, A, "12", "2/204", None, 15.0, 1.0, "tarwia", "تروية", "ترددي", "1", "E1", None, "R1", "residence", "H1", "camp", "C3", None, "p6"),
]

KEY_A, KEY_B = "شركة مكة", "يسر"
