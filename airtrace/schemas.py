"""Schemas (DDL text) of the landed snapshots and of the stored tables."""

from __future__ import annotations

FLIGHT_PLAN = (
    "struct<flight_rules:string,aircraft:string,aircraft_faa:string,aircraft_short:string,"
    "departure:string,arrival:string,alternate:string,cruise_tas:string,altitude:string,"
    "deptime:string,enroute_time:string,fuel_time:string,remarks:string,route:string,"
    "revision_id:int,assigned_transponder:string>"
)

SNAPSHOT = (
    "pilots array<struct<cid:int,name:string,callsign:string,server:string,pilot_rating:int,"
    "military_rating:int,latitude:double,longitude:double,altitude:int,groundspeed:int,"
    f"transponder:string,heading:int,qnh_i_hg:double,qnh_mb:int,flight_plan:{FLIGHT_PLAN},"
    "logon_time:string,last_updated:string>>,"
    "controllers array<struct<cid:int,name:string,callsign:string,frequency:string,facility:int,"
    "rating:int,server:string,visual_range:int,text_atis:array<string>,last_updated:string,"
    "logon_time:string>>"
)

RADIO_ENTRY = (
    "callsign:string,transceivers:array<struct<id:int,frequency:bigint,latDeg:double,"
    "lonDeg:double,heightMslM:double,heightAglM:double,timestamp:string>>"
)

# One landed poll: both feeds of a minute in one document.
POLL = f"poll_time string, {SNAPSHOT}, transceivers array<struct<{RADIO_ENTRY}>>"

FLIGHTS = (
    "id bigint, callsign string, aircraft_type string, latitude double, longitude double,"
    "altitude int, heading int, groundspeed int, departure string, arrival string, route string,"
    "flight_rules string, aircraft_faa string, aircraft_short string, alternate string,"
    "cruise_tas string, planned_altitude string, deptime string, enroute_time string,"
    "fuel_time string, remarks string, last_updated timestamp, cid int, name string,"
    "server string, pilot_rating int, military_rating int, transponder string,"
    "logon_time timestamp"
)

CONTROLLERS = (
    "id bigint, callsign string, frequency string, cid int, name string, rating int,"
    "facility int, visual_range int, text_atis string, server string, last_updated timestamp,"
    "logon_time timestamp, created_at timestamp"
)

TRANSCEIVERS = (
    "id bigint, callsign string, transceiver_id int, frequency bigint, position_lat double,"
    "position_lon double, height_msl double, height_agl double, entity_type string,"
    "timestamp timestamp"
)

CONTACT = (
    "struct<callsign:string,type:string,time_minutes:double,first_contact:timestamp,"
    "last_contact:timestamp,contact_count:bigint>"
)
AIRCRAFT_DETAIL = (
    "struct<callsign:string,frequency_mhz:double,first_seen:timestamp,last_seen:timestamp,"
    "time_on_frequency_minutes:bigint,updates_count:bigint>"
)

FLIGHT_SUMMARIES = (
    "id bigint, callsign string, aircraft_type string, departure string, arrival string,"
    "deptime string, logon_time timestamp, route string, flight_rules string,"
    "aircraft_faa string, planned_altitude string, aircraft_short string, cid int, name string,"
    "server string, pilot_rating int, military_rating int,"
    f"controller_callsigns map<string,{CONTACT}>, controller_time_percentage decimal(5,2),"
    "airborne_controller_time_percentage decimal(5,2), time_online_minutes int,"
    "primary_enroute_sector string, total_enroute_sectors int, total_enroute_time_minutes int,"
    "sector_breakdown map<string,int>, completion_time timestamp, created_at timestamp"
)

CONTROLLER_SUMMARIES = (
    "id bigint, callsign string, cid int, name string, session_start_time timestamp,"
    "session_end_time timestamp, session_duration_minutes int, rating int, facility int,"
    "server string, total_aircraft_handled int, peak_aircraft_count int,"
    "hourly_aircraft_breakdown map<int,int>, frequencies_used array<string>,"
    f"aircraft_details array<{AIRCRAFT_DETAIL}>, created_at timestamp"
)

SECTOR_OCCUPANCY = (
    "callsign string, sector_name string, entry_timestamp timestamp, exit_timestamp timestamp,"
    "duration_seconds int, entry_lat double, entry_lon double, exit_lat double, exit_lon double,"
    "entry_altitude int, exit_altitude int"
)

TABLES = {
    "flights": FLIGHTS,
    "controllers": CONTROLLERS,
    "transceivers": TRANSCEIVERS,
    "flight_summaries": FLIGHT_SUMMARIES,
    "controller_summaries": CONTROLLER_SUMMARIES,
    "flight_sector_occupancy": SECTOR_OCCUPANCY,
}
